"""The codec on hand-checked encodings, adversarial texts and broken streams."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from glyphmill.operators import arrowcodec, codec, dictionary, tokens

# Texts and their encodings in the format.
GOLDEN = {
    "Hola mundo.": "000202180219002E", "HOLA MUNDO": "0003021800030219", "hola, mundo": "0218002C00200219", "hola,mundo": "0218002C0219", "hola  mundo": "0218002000200219",
    "hola\tmundo": "021800090219", "A e o u y.": "000300610065006F00750079002E", "2026": "0032003000320036", "€100": "0080003100300030", "hola—mundo": "021800970219",
    "hola mexicanico mundo": "0218002000006D65786963616E69636F000100200219", "ß": "0000C39F0001", "\0": "000000000001", "\x03": "0000030001", "\x0b": "00000B0001", "\xa0": "0000C2A00001",
    "café": "000063616665CC810001", "́": "0000CC810001", "😀": "0000F09F98800001", " ": "0020", "": "",
}
# End of the fixed values.
TRICKY = [
    "¿Eres Mexicanico?", "TODO está BIEN.", "«Hola», dijo él —y continuó…", "hola ,mundo", "él—y", "él— y", "a b", "ab", "  hola", "hola  ", "\r\nhola\r\n", " \t hola \r\n mundo \n ",
    "mExIcO meXico Hola", "Ελλάδα Москва 日本語 中文 العربية", "café café", "!!! ??? ...", "a@b.mx https://x.mx/?q=1&r=2", "A E O U Y", "a,y", "\0\1\2\3", "".join(map(chr, range(16))),
    "İstanbul STRASSE straße Kelvin Ünico", "x" * 5000, "\0" * 300, "hola \x1f mundo hola", "mundo\x85hola", "Hola HOLA hola mundo Mundo",
]
BROKEN = {
    "02": "ODD_LENGTH", "0001": "LITERAL_END_OUTSIDE", "0002": "DANGLING_MODIFIER", "000200020218": "CONSECUTIVE_MODIFIERS", "00020000410001": "LITERAL_AFTER_MODIFIER", "0002002E": "MODIFIER_ON_DIRECT",
    "0004": "RESERVED_CONTROL", "0100": "RESERVED_EXTENSION", "0081": "UNASSIGNED_DIRECT", "FFFF": "UNKNOWN_TOKEN", "000041": "UNTERMINATED_LITERAL", "00004100": "TRUNCATED_ESCAPE", "00000002": "BAD_ESCAPE", "0000FF0001": "INVALID_UTF8",
}


@pytest.fixture(scope="module")
def words(spark):
    return spark.createDataFrame([(1, 536, "hola", 2), (2, 537, "mundo", 1)], "ranking int, token int, word string, frequency long").cache()


def round_trip(spark, texts, words):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").cache()
    encoded = codec.encode(docs, words).cache()
    back = {r.doc_id: r for r in codec.decode(encoded, words).collect()}
    return {r.doc_id: bytes(r.encoded) for r in encoded.collect()}, back, docs


def test_golden_and_tricky_texts(spark, words):
    texts = [*GOLDEN, *TRICKY]
    encoded, back, docs = round_trip(spark, texts, words)
    for k, text in enumerate(texts):
        assert back[k].error is None and back[k].text == text, repr(text)
        if text in GOLDEN:
            assert encoded[k].hex().upper() == GOLDEN[text], repr(text)
    stats = {r.doc_id: r for r in codec.statistics(docs, words).collect()}
    for k, text in enumerate(texts):
        s = stats[k]
        assert (s.encoded_bytes, s.utf8_bytes, s.characters) == (len(encoded[k]), len(text.encode()), len(text)), repr(text)
        assert back[k].reconstructed_implicit_spaces == s.implicit_spaces
    blank = stats[texts.index("\x0b")]
    assert (blank.literal_items, blank.literal_payload_bytes, blank.explicit_whitespace_items) == (0, 1, 1)
    assert stats[texts.index("")].reduction_percentage == 0.0


def test_pairs_and_random_bytes(spark, words):
    rng = random.Random(16)
    texts = ["".join(map(chr, p)) for p in itertools.product([0, 1, 2, 3, 9, 10, 13, 32, 65, 97, 128, 160, 255], repeat=2)]
    texts += ["".join(chr(rng.randrange(256)) for _ in range(64)) for _ in range(200)]
    _, back, _ = round_trip(spark, texts, words)
    assert [back[k].text for k in range(len(texts))] == texts


def test_null_text(spark, words):
    docs = spark.createDataFrame([(1, None), (2, "hola")], "doc_id long, text string")
    encoded = codec.encode(docs, words)
    assert {r.doc_id: r.encoded for r in encoded.collect()} == {1: None, 2: bytearray(b"\x02\x18")}
    assert {r.doc_id: r.text for r in codec.decode(encoded, words).collect()} == {1: None, 2: "hola"}


def test_collisions(spark, words):
    pairs = [("hola mundo", "holamundo"), ("hola, mundo", "hola,mundo"), ("hola ,mundo", "hola,mundo"), ("él —y", "él—y"), ("él— y", "él—y"), ("¿ hola", "¿hola"), ("hola ?", "hola?"), ("a b", "ab")]
    encoded, _, _ = round_trip(spark, [t for p in pairs for t in p], words)
    assert all(encoded[2 * k] != encoded[2 * k + 1] for k in range(len(pairs)))


def test_broken_streams(spark, words):
    rows = [(k, bytearray.fromhex(h)) for k, h in enumerate(BROKEN)]
    out = {r.doc_id: (r.error, r.text) for r in codec.decode(spark.createDataFrame(rows, "doc_id long, encoded binary"), words).collect()}
    assert out == {k: (e, None) for k, e in enumerate(BROKEN.values())}
    with pytest.raises(Exception, match="ODD_LENGTH"):
        codec.decode_strict(spark.createDataFrame(rows[:1], "doc_id long, encoded binary"), words).collect()


def test_repeated_keys_stay_apart(spark, words):
    docs = spark.createDataFrame([(1, "hola mundo"), (1, "Hola"), (None, "mundo"), (None, "mundo")], "doc_id long, text string").repartition(3)
    encoded = codec.encode(docs, words)
    both = [sorted((str(r.doc_id), bytes(r.encoded)) for r in e.collect()) for e in (encoded, arrowcodec.encode(docs, words))]
    assert both[0] == both[1] and len(both[0]) == 4
    assert sorted((str(r.doc_id), r.text) for r in codec.decode(encoded, words).collect()) == sorted((str(r.doc_id), r.text) for r in docs.collect())
    assert codec.statistics(docs, words).count() == 4


def test_long_literal(spark, words):
    text = "ж" * 300_000 + "\0" * 2000 + "я" * 1000
    _, back, _ = round_trip(spark, [text], words)
    assert back[0].text == text


def test_token_shuffle_is_of_texts_only(spark, words):
    docs = spark.createDataFrame([(1, "hola mundo")], "doc_id long, text string")
    plan = codec.encode(docs, words)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_dictionary_rules(spark):
    make = lambda rows: dictionary.validate(spark.createDataFrame(rows, "ranking int, token int, word string")).first().error
    assert make([(1, 536, "a"), (2, 537, "b")]) is None
    assert make([]) == "EMPTY"
    assert make([(1, 536, "a"), (2, 537, "a")]) == "REPEATED_WORD"
    assert make([(1, 536, "a"), (2, 536, "b")]) == "REPEATED_TOKEN"
    assert make([(1, 536, "a"), (3, 538, "b")]) == "RANKS_NOT_CONSECUTIVE"
    assert make([(1, 537, "a")]) == "TOKEN_NOT_RANK_PLUS_535"


def test_tokens(spark):
    docs = spark.createDataFrame([(k, t) for k, t in enumerate([*GOLDEN, *TRICKY])], "doc_id long, text string")
    assert docs.where(tokens.validation(F.col("text")).isNotNull()).count() == 0
    rows = tokens.with_offsets(tokens.tokenize(docs, "doc_id")).join(docs, "doc_id")
    assert rows.where("substring(text, start + 1, end - start) <> token").count() == 0


def test_both_codecs_agree(spark, words):
    texts = [*GOLDEN, *TRICKY, None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").cache()
    fast = arrowcodec.encode(docs, words).cache()
    assert {r.doc_id: r.encoded for r in fast.collect()} == {r.doc_id: r.encoded for r in codec.encode(docs, words).collect()}
    assert {r.doc_id: (r.text, r.error) for r in arrowcodec.decode(fast, words).collect()} == {k: (t, None) for k, t in enumerate(texts)}
    rows = [(k, bytearray.fromhex(h)) for k, h in enumerate(BROKEN)]
    out = {r.doc_id: (r.error, r.text) for r in arrowcodec.decode(spark.createDataFrame(rows, "doc_id long, encoded binary"), words).collect()}
    assert out == {k: (e, None) for k, e in enumerate(BROKEN.values())}


def main_plan(df):
    """The lines of a plan without those of its subqueries."""
    return [line for line in df._jdf.queryExecution().optimizedPlan().toString().split("\n") if not line.lstrip().startswith(":")]


def test_documents_are_coded_whole(spark, words):
    docs = spark.createDataFrame([(1, "hola mundo")], "doc_id long, text string")
    encoded = codec.encode(docs, words)
    for df in (encoded, codec.decode(encoded, words), codec.statistics(docs, words)):
        lines = main_plan(df)
        assert not any(name in line for line in lines for name in ("Generate", "Window", "Aggregate", "Sort", "Join")), lines
        assert not any("AS _table#" in line for line in lines)  # else each row gets a copy of the dictionary


def test_words_of_all_cases_in_a_large_dictionary(spark):
    """Against the codec over Arrow batches: many words share a list of token_codes()."""
    rng = random.Random(5)
    names = sorted({"".join(rng.choice("aeinorstßéж") for _ in range(rng.randrange(1, 6))) for _ in range(30_000)})
    many = spark.createDataFrame([(k + 1, 536 + k, w, 1) for k, w in enumerate(names)], "ranking int, token int, word string, frequency long").cache()
    texts = [" ".join(rng.choice((str.lower, str.upper, str.capitalize, str.swapcase))(rng.choice(names)) for _ in range(500)) for _ in range(40)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").cache()
    encoded = codec.encode(docs, many).cache()
    assert {r.doc_id: r.encoded for r in encoded.collect()} == {r.doc_id: r.encoded for r in arrowcodec.encode(docs, many).collect()}
    assert {r.doc_id: (r.text, r.error) for r in codec.decode(encoded, many).collect()} == {k: (t, None) for k, t in enumerate(texts)}


def test_counters_of_broken_streams(spark, words):
    rows = [(0, bytearray.fromhex("02180219" + "0002" + "0218")), (1, bytearray.fromhex("0218FFFF0020" + "0000410001" + "02")), (2, bytearray.fromhex("0003" + "00010002")), (3, None)]
    out = {r.doc_id: r for r in codec.decode(spark.createDataFrame(rows, "doc_id long, encoded binary"), words).collect()}
    counters = lambda r: (r.error, r.lexical_items, r.direct_items, r.literal_items, r.modifier_items, r.explicit_whitespace_items, r.reconstructed_implicit_spaces)
    assert counters(out[0]) == (None, 3, 0, 0, 1, 0, 2) and out[0].text == "hola mundo Hola"
    assert counters(out[1]) == ("UNKNOWN_TOKEN", 2, 1, 1, 0, 1, 1) and out[1].encoded_bytes == 12
    assert counters(out[2]) == ("LITERAL_END_OUTSIDE", 0, 1, 0, 2, 0, 0) and counters(out[3]) == (None, 0, 0, 0, 0, 0, 0)


def test_counters_of_both_codecs_agree(spark, words):
    tails = ["", *BROKEN, "0003", "0000", "0002FFFF", "0000410001" * 3, "0218000302190219", "0002000041000102"]
    rows = [(k, bytearray.fromhex(a + b)) for k, (a, b) in enumerate(itertools.product(["", "0218", "00020218001F", "0020021902180061", "0000C3A900010218", "0000000000010003"], tails))]
    rng = random.Random(8)
    rows += [(len(rows) + k, bytearray(rng.choice([0, 0, 1, 2, 3, 24, 25, 65, 97, 255]) for _ in range(rng.randrange(24)))) for k in range(1500)] + [(-1, None)]
    streams = spark.createDataFrame(rows, "doc_id long, encoded binary").cache()
    slow, fast = codec.decode(streams, words), arrowcodec.decode(streams, words)
    assert slow.columns == fast.columns and slow.dtypes == fast.dtypes
    assert sorted(map(tuple, slow.collect()), key=str) == sorted(map(tuple, fast.collect()), key=str)
