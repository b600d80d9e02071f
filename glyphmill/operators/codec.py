"""The lossless codec: tokens to codes to bytes, and back.

encode(), statistics() and decode() take a document at a time: its tokens or units are an array, and what each of them
stands for is looked up in a table that the dictionary makes once, so tokens are neither rows nor shuffled nor sorted.
coded() and represent() give tokens as rows instead: texts are dealt out once, before they are cut into tokens; windows,
dictionary joins and the final grouping all keep that partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glyphmill.functions.codes import (
    CAPITALIZED,
    CR,
    FUTURE_CONTROLS,
    LEXICAL_FIRST,
    LF,
    RESERVED_FIRST,
    SINGLE_LETTERS,
    SLOTS,
    SPACE,
    TAB,
    TYPOGRAPHY,
    UPPERCASE,
    code_hex,
    direct_char,
    direct_code,
)

from glyphmill.functions.text import WS, let

from .dictionary import small
from .tokens import token_array, token_type, tokenize

#: Over bytes read as Latin-1: a closed literal (possessive loops, so that long ones need no stack), or one code.
UNIT = r"\x00\x00[^\x00]*+(?:\x00\x00[^\x00]*+)*+\x00\x01|[\s\S]{2}"
COUNTERS = ("lexical_items", "direct_items", "literal_items", "literal_payload_bytes", "implicit_spaces", "explicit_single_spaces", "explicit_whitespace_items", "modifier_items")


def case_modifier(word: Column) -> Column:
    """NONE, UPPERCASE or CAPITALIZED, in that order of tests; NONE for mixed case."""
    first, rest = F.substring(word, 1, 1), F.substr(word, F.lit(2))
    return F.when(word == F.lower(word), "NONE").when(word == F.upper(word), "UPPERCASE").when((first == F.upper(first)) & (rest == F.lower(rest)), "CAPITALIZED").otherwise("NONE")


def apply_modifier(word: Column, modifier: Column) -> Column:
    return F.when(modifier == "UPPERCASE", F.upper(word)).when(modifier == "CAPITALIZED", F.concat(F.upper(F.substring(word, 1, 1)), F.substr(word, F.lit(2)))).otherwise(word)


def represent(tokens: DataFrame, dictionary: DataFrame) -> DataFrame:
    """tokens with modifier, word (normalized), kind and code.

    kind: LEXICAL, DIRECT, LITERAL, IMPLICIT_SPACE (a single space, a candidate) or EXPLICIT_WHITESPACE. A word whose
    modifier doesn't give it back from its lower case (there are a few such letters) is a literal.
    """
    return judged(normalized(tokens).join(small(dictionary.select("word", F.col("token").alias("lexical"))), "word", "left"))


def normalized(tokens: DataFrame) -> DataFrame:
    """tokens with modifier and word, by which the dictionary has them."""
    word, t = F.col("type") == "WORD", F.col("token")
    lowered = F.lower(t)
    out = tokens.withColumn("modifier", F.when(word, case_modifier(t)).otherwise("NONE"))
    mixed = (F.col("modifier") == "NONE") & (t != lowered)
    return out.withColumn("word", F.when(word, F.when(mixed, t).otherwise(lowered)))


def judged(out: DataFrame) -> DataFrame:
    """normalized() rows, with what the dictionary has for their words as lexical, with kind and code."""
    word, t = F.col("type") == "WORD", F.col("token")
    back = apply_modifier(F.col("word"), F.col("modifier")) == t
    single = word & F.col("word").isin(*SINGLE_LETTERS) & back
    lexical = word & F.col("lexical").isNotNull() & back
    direct = F.when(single, F.ascii("word")).when(F.col("type") == "CHARACTER", direct_code(t))
    control = direct.isin(0, 1, 2, 3, *FUTURE_CONTROLS)
    kind = (
        F.when(t.isNull(), None).when(t == " ", "IMPLICIT_SPACE").when(F.col("type") == "WHITESPACE", "EXPLICIT_WHITESPACE")
        .when(lexical & ~single, "LEXICAL").when(direct.isNotNull() & ~control, "DIRECT").otherwise("LITERAL")
    )
    out = out.withColumn("kind", kind)
    code = F.when(F.col("kind") == "LEXICAL", F.col("lexical")).when(F.col("kind") == "DIRECT", direct)
    out = out.withColumn("code", code).withColumn("modifier", F.when(F.col("kind").isin("LEXICAL", "DIRECT"), F.col("modifier")).otherwise("NONE"))
    return out.drop("lexical")


def placed(rows: DataFrame, key: str) -> DataFrame:
    """represent() rows with implicit: whether a single space is left out, as both neighbours are words with codes."""
    plain = F.coalesce((F.col("type") == "WORD") & F.col("kind").isin("LEXICAL", "DIRECT"), F.lit(False))
    w = Window.partitionBy(key).orderBy("pos")
    both = F.coalesce(F.lag("plain").over(w), F.lit(False)) & F.coalesce(F.lead("plain").over(w), F.lit(False))
    return rows.withColumn("plain", plain).withColumn("implicit", (F.col("kind") == "IMPLICIT_SPACE") & both).drop("plain")


def utf8_hex(text: Column) -> Column:
    return F.hex(F.encode(text, "UTF-8"))


def literal_hex(text: Column) -> Column:
    """A literal's codes; only the token NUL holds a byte that is stuffed."""
    return F.concat(F.lit("0000"), F.when(text == "\0", "0000").otherwise(utf8_hex(text)), F.lit("0001"))


def emitted(rows: DataFrame) -> DataFrame:
    """placed() rows with hex, the codes of each token."""
    t, kind = F.col("token"), F.col("kind")
    modifier = F.when(F.col("modifier") == "CAPITALIZED", f"{CAPITALIZED:04X}").when(F.col("modifier") == "UPPERCASE", f"{UPPERCASE:04X}").otherwise("")
    blank = F.array_join(F.transform(F.split(t, ""), lambda c: F.when(c.isin(" ", "\t", "\n", "\r"), code_hex(F.ascii(c))).when(c == "", "").otherwise(literal_hex(c))), "")
    made = (
        F.when(kind.isin("LEXICAL", "DIRECT"), F.concat(modifier, code_hex(F.col("code")))).when(kind == "LITERAL", literal_hex(t))
        .when(kind == "IMPLICIT_SPACE", F.when(F.col("implicit"), "").otherwise(f"{SPACE:04X}")).when(kind == "EXPLICIT_WHITESPACE", blank)
    )
    return rows.withColumn("hex", made)


def dealt(docs: DataFrame, key: str, *columns: str) -> DataFrame:
    """The columns asked for, with _row, a number of each row, by which rows are dealt out: documents that repeat a key stay apart."""
    return docs.select(key, "text", *[c for c in columns if c not in (key, "text")]).withColumn("_row", F.monotonically_increasing_id()).repartition("_row")


def coded(docs: DataFrame, dictionary: DataFrame, key: str = "doc_id", *columns: str) -> DataFrame:
    """placed() rows of whole documents; a document without tokens keeps a row of nulls."""
    return placed(represent(tokenize(dealt(docs, key, *columns), "_row", key, *columns, outer=True), dictionary), "_row")


#: Lists that the codes of tokens are spread over by hash, so that a list is short and a token is found without a search.
LISTS = 1 << 16
WORD_KINDS = "LMSs"  # kinds of token_codes() that are words with codes: lexical and single letters, then the same with a modifier before them


def token_codes(dictionary: DataFrame) -> Column:
    """All tokens that have codes: an array by hash, of maps from token to hex, kind, word (whether it is one) and other (null), as a scalar subquery.

    kind is one letter: L, M, S or s for words, D for other characters, B for the single space. A token with a code is a
    word of the dictionary or a single letter, itself, in upper case or capitalized, or one of the direct characters.
    """
    listed = F.collect_list(F.struct("word", F.col("token").cast("int").alias("lexical")))
    held = dictionary.select("word", "token").limit(SLOTS + 1).agg(listed.alias("all")).select(F.when(F.size("all") <= SLOTS, F.col("all")).otherwise(F.raise_error(F.lit("a dictionary has at most 65,000 words")).cast("array<struct<word:string,lexical:int>>")).alias("all"))
    first = lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substr(w, F.lit(2)))
    row = lambda token, entry, lexical, n: F.struct(token.cast("string").alias("token"), entry.cast("string").alias("entry"), lexical.cast("int").alias("lexical"), n.cast("int").alias("list"))
    none = F.lit(None)
    forms = F.flatten(F.transform("all", lambda x: F.array(*[row(t, x["word"], x["lexical"], none) for t in (x["word"], F.upper(x["word"]), first(x["word"]))])))
    fixed = F.array(*[F.lit(c) for c in [*SINGLE_LETTERS, *map(str.upper, SINGLE_LETTERS), *map(chr, range(256)), *TYPOGRAPHY.values()]])
    empty = F.transform(F.sequence(F.lit(0), F.lit(LISTS - 1)), lambda n: row(none, none, none, n))  # each list is there, if only with this
    rows = held.select(F.explode(F.concat(forms, F.transform(fixed, lambda c: row(c, none, none, none)), empty)).alias("x")).select("x.*")
    rows = normalized(rows.withColumn("type", token_type(F.col("token")))).where("entry is null or entry = word")
    rows = emitted(judged(rows).withColumn("implicit", F.lit(False)))
    modified, kind = F.col("modifier") != "NONE", F.col("kind")
    letter = (
        F.when(kind == "IMPLICIT_SPACE", "B").when(kind == "LEXICAL", F.when(modified, "M").otherwise("L"))
        .when((kind == "DIRECT") & (F.col("type") == "WORD"), F.when(modified, "s").otherwise("S")).when(kind == "DIRECT", "D")
    )
    found = rows.select(F.coalesce("list", F.pmod(F.hash("token"), F.lit(LISTS))).alias("list"), F.when(letter.isNotNull(), F.col("token")).alias("token"), F.struct("hex", letter.alias("kind"), letter.isin(*WORD_KINDS).alias("word"), none.cast("string").alias("other")).alias("code"))
    found = found.groupBy("list", "token").agg(F.min("code").alias("code")).groupBy("list").agg(F.map_from_entries(F.collect_list(F.when(F.col("token").isNotNull(), F.struct("token", "code")))).alias("codes"))
    return found.agg(F.transform(F.array_sort(F.collect_list(F.struct("list", "codes")), lambda x, y: x["list"] - y["list"]), lambda x: x["codes"]).alias("t")).scalar()


def blank_hex(run: Column) -> Column:
    """The codes of a run of white space."""
    return F.array_join(F.transform(F.split(run, ""), lambda c: F.when(c.isin(" ", "\t", "\n", "\r"), code_hex(F.ascii(c))).when(c == "", "").otherwise(literal_hex(c))), "")


def with_codes(docs: DataFrame, dictionary: DataFrame, counted: bool = True) -> DataFrame:
    """docs with _codes, null for a null text: codes (hex of the stream) and, if counted, kinds (a letter a token: those of token_codes(), T for literals, W for runs of white space) and others (the tokens of T and W, joined)."""
    kept = lambda t, hex_, kind: F.struct(hex_.alias("hex"), F.lit(kind).alias("kind"), F.lit(False).alias("word"), t.alias("other"))
    other = lambda t: F.when(t.rlike(f"^[{WS}]"), kept(t, blank_hex(t), "W")).otherwise(kept(t, literal_hex(t), "T"))
    each = lambda t: F.coalesce(F.try_element_at(F.get(F.col("_table"), F.pmod(F.hash(t), F.lit(LISTS))), t), other(t))
    left_out = lambda p, x, i: (x["kind"] == "B") & F.coalesce(F.get(p, i - 1)["word"] & F.get(p, i + 1)["word"], F.lit(False))
    joined = lambda p, f: F.array_join(F.transform(p, f), "")

    field = lambda n: lambda x: x[n]

    def made(p: Column) -> Column:
        codes = joined(p, lambda x, i: F.when(left_out(p, x, i), "").otherwise(x["hex"])).alias("codes")
        return F.struct(codes, *[joined(p, field(n)).alias(f"{n}s") for n in ("kind", "other")]) if counted else F.struct(codes)

    # the subquery takes the place of _table, used once, instead of being copied to each row (a test looks at the plan)
    rows = docs.withColumn("_table", token_codes(dictionary))
    return rows.select(*docs.columns, F.when(F.col("text").isNotNull(), let(F.transform(token_array(F.col("text")), each), made)).alias("_codes"))


def encode(docs: DataFrame, dictionary: DataFrame, key: str = "doc_id") -> DataFrame:
    """key and encoded (bytes; empty for an empty text, null for null)."""
    return with_codes(dealt(docs, key), dictionary, counted=False).select(key, F.unhex("_codes.codes").alias("encoded"))


def letters(of: Column, which: str) -> Column:
    """How many of the letters there are."""
    return len(which) * F.char_length(of) - sum((F.char_length(F.replace(of, F.lit(c), F.lit(""))) for c in which), F.lit(0))


def token_counters() -> dict[str, Column]:
    """tokens, the counters and encoded_bytes of with_codes() rows: sizes follow from the tokens, not from the stream."""
    kinds, others = F.coalesce("_codes.kinds", F.lit("")), F.coalesce("_codes.others", F.lit(""))
    n = lambda which: letters(kinds, which)
    payload = F.regexp_replace(others, r"[ \t\n\r]", "")
    lexical, direct, literal, modified, blank = n("LM"), n("SsD"), n("T"), n("Ms"), n("W")
    implicit = F.regexp_count(kinds, F.lit(f"[{WORD_KINDS}]B(?=[{WORD_KINDS}])"))
    explicit, bytes_ = n("B") - implicit, F.octet_length(payload)
    codes = lexical + direct + modified + explicit + F.char_length(others) - F.char_length(payload)
    return {
        "tokens": F.char_length(kinds), "lexical_items": lexical, "direct_items": direct, "literal_items": literal, "literal_payload_bytes": bytes_, "implicit_spaces": implicit,
        "explicit_single_spaces": explicit, "explicit_whitespace_items": blank, "modifier_items": modified, "encoded_bytes": 2 * codes + 4 * (literal + F.regexp_count(payload, F.lit(f"[{WS}]"))) + bytes_ + letters(payload, "\0"),
    }


def measured(docs: DataFrame, dictionary: DataFrame, key: str = "doc_id", *columns: str) -> DataFrame:
    """statistics() with text and encoded."""
    rows = with_codes(dealt(docs, key, *columns), dictionary)
    counters = {k: v.cast("long").alias(k) for k, v in token_counters().items()}
    sizes = [F.coalesce(f("text"), F.lit(0)).cast("long").alias(n) for n, f in (("characters", F.char_length), ("utf8_bytes", F.octet_length))]
    return reduced(rows.select(key, *columns, "text", F.unhex("_codes.codes").alias("encoded"), counters.pop("tokens"), *sizes, counters.pop("encoded_bytes"), *counters.values()))


def statistics(docs: DataFrame, dictionary: DataFrame, key: str = "doc_id", *columns: str) -> DataFrame:
    """Per document: tokens, characters, utf8_bytes, encoded_bytes, the counters, reduction_bytes and reduction_percentage."""
    return measured(docs, dictionary, key, *columns).drop("text", "encoded")


def reduced(stats: DataFrame) -> DataFrame:
    saved = F.col("utf8_bytes") - F.col("encoded_bytes")
    share = F.when(F.col("utf8_bytes") == 0, 0.0).otherwise(F.round(100.0 * saved / F.col("utf8_bytes"), 6))
    return stats.withColumn("reduction_bytes", saved).withColumn("reduction_percentage", share)


def totals(stats: DataFrame, *keys: str) -> DataFrame:
    """statistics() summed over documents, by keys."""
    names = ["characters", "utf8_bytes", "encoded_bytes", *COUNTERS]
    return reduced(stats.groupBy(*keys).agg(F.count(F.lit(1)).alias("documents"), *[F.sum(n).alias(n) for n in names]))


def unit_codes(dictionary: DataFrame) -> Column:
    """What each code stands for: an array by code, of value, kind (a letter) and word (whether it is one), as a scalar subquery; codes past its end are unknown.

    Letters: L word, U unknown word, S single letter, W white space, D other character, X unassigned, R reserved extension,
    F future control, O and E the ends of literals, C and P modifiers.
    """
    listed = dictionary.select("word", "token").limit(SLOTS + 1).agg(F.collect_list(F.struct(F.col("token").cast("int").alias("code"), "word")).alias("all"))
    listed = listed.select(F.when(F.size("all") <= SLOTS, F.col("all")).otherwise(F.raise_error(F.lit("a dictionary has at most 65,000 words")).cast("array<struct<code:int,word:string>>")).alias("all"))
    every = F.transform(F.sequence(F.lit(0), F.greatest(F.coalesce(F.array_max("all")["code"], F.lit(0)), F.lit(LEXICAL_FIRST - 1))), lambda k: F.struct(k.cast("int").alias("code"), F.lit(None).cast("string").alias("word")))
    rows = listed.select(F.explode(F.concat("all", every)).alias("x")).groupBy("x.code").agg(F.min("x.word").alias("entry"))
    code = F.col("code")
    char = direct_char(code)
    kind = (
        F.when(code == 0, "O").when(code == 1, "E").when(code == CAPITALIZED, "C").when(code == UPPERCASE, "P").when(code.isin(*FUTURE_CONTROLS), "F").when(code.between(RESERVED_FIRST, LEXICAL_FIRST - 1), "R")
        .when(code >= LEXICAL_FIRST, F.when(F.col("entry").isNull(), "U").otherwise("L")).when(char.isNull(), "X").when(F.lower(char).isin(*SINGLE_LETTERS), "S").when(code.isin(SPACE, TAB, LF, CR), "W").otherwise("D")
    )
    value = F.when(kind == "L", F.col("entry")).when(kind.isin("S", "W", "D"), char)
    units = F.struct("code", value.alias("value"), kind.alias("kind"), kind.isin("L", "U", "S").alias("word"))
    return rows.agg(F.transform(F.array_sort(F.collect_list(units)), lambda x: F.struct(x["value"], x["kind"], x["word"])).alias("t")).scalar()


#: Over kinds of units: where a stream is broken, and words with a space before them (a modifier and the unit after it are one word).
WRONG, GAP = r"[OIEFRUX]|[CP][TIOWDCP]|[CP]\z", "[LUS][CP]?(?=[LUS])"
ERRORS = {"I": "INVALID_UTF8", "E": "LITERAL_END_OUTSIDE", "F": "RESERVED_CONTROL", "R": "RESERVED_EXTENSION", "U": "UNKNOWN_TOKEN", "X": "UNASSIGNED_DIRECT"}


def with_units(rows: DataFrame, dictionary: DataFrame) -> DataFrame:
    """rows with _read in place of encoded: kinds (a letter a unit: those of unit_codes(), T for literals, I for literals that aren't UTF-8), text (null where a unit is wrong), size, parsed (what units cover of it) and cut (what is wrong with a literal)."""
    code = lambda u: F.ascii(u) * 256 + F.ascii(F.substring(u, 2, 1))
    body = lambda u: F.encode(F.replace(F.substring(u, F.lit(3), F.char_length(u) - 4), F.lit("\0\0"), F.lit("\0")), "ISO-8859-1").cast("string")
    unit = lambda value, kind: F.struct(value.cast("string").alias("value"), F.lit(kind).alias("kind"), F.lit(False).alias("word"))
    literal = lambda u: let(body(u), lambda b: F.when(F.is_valid_utf8(b), unit(b, "T")).otherwise(unit(F.lit(None), "I")))
    unknown = F.struct(F.lit(None).cast("string").alias("value"), F.lit("U").alias("kind"), F.lit(True).alias("word"))
    each = lambda u: F.when(F.char_length(u) > 2, literal(u)).otherwise(F.coalesce(F.get(F.col("_table"), code(u)), unknown))

    def piece(p: Column, x: Column, i: Column) -> Column:
        before = F.get(p, i - 1)
        cased = F.when(before["kind"] == "P", F.upper(x["value"])).when(before["kind"] == "C", F.concat(F.upper(F.substring(x["value"], 1, 1)), F.substr(x["value"], F.lit(2)))).otherwise(x["value"])
        prior = F.when(before["kind"].isin("C", "P"), F.get(p, i - 2)["word"]).otherwise(before["word"])
        return F.when(x["word"], F.when(prior, F.concat(F.lit(" "), cased)).otherwise(cased)).otherwise(x["value"])

    text = lambda p: F.array_join(F.transform(p, lambda x, i: piece(p, x, i)), "")
    def read(stream: Column, units: Column, p: Column, k: Column) -> Column:
        cut = F.when(k.contains("O"), cut_literal(stream, units))
        return F.struct(k.alias("kinds"), F.when(~k.rlike(WRONG), text(p)).alias("text"), F.char_length(stream).alias("size"), F.char_length(F.array_join(units, "")).alias("parsed"), cut.alias("cut"))

    kinds = lambda p: F.array_join(F.transform(p, lambda x: x["kind"]), "")
    of_units = lambda s, u: let(F.transform(u, each), lambda p: let(kinds(p), lambda k: read(s, u, p, k)))
    whole = lambda s: let(F.regexp_extract_all(s, F.lit(UNIT), F.lit(0)), lambda u: of_units(s, u))
    # each column is used once, so that the subquery takes the place of _table instead of being copied to each row (a test looks at the plan)
    out = rows.withColumn("_table", unit_codes(dictionary))
    return out.select(*[c for c in rows.columns if c != "encoded"], let(F.decode(F.col("encoded"), "ISO-8859-1"), whole).alias("_read"))


def cut_literal(stream: Column, units: Column) -> Column:
    """What is wrong with the first literal of a stream that isn't closed."""
    before = F.char_length(F.array_join(F.slice(units, F.lit(1), F.array_position(units, "\0\0").cast("int") - 1), ""))
    body = r"\A\x00\x00[^\x00]*+(?:\x00\x00[^\x00]*+)*+"
    return let(F.substr(stream, before + 1), lambda rest: F.when(rest.rlike(body + r"\z"), "UNTERMINATED_LITERAL").when(rest.rlike(body + r"\x00\z"), "TRUNCATED_ESCAPE").otherwise("BAD_ESCAPE"))


def decode(encoded: DataFrame, dictionary: DataFrame, key: str = "doc_id", *columns: str) -> DataFrame:
    """key, columns, text, error and the decoder's counters.

    error is the first of the stream, by position; text is null then, and for null bytes.
    """
    rows = with_units(encoded.select(key, "encoded", *columns), dictionary)
    kinds = F.coalesce("_read.kinds", F.lit(""))
    at = F.regexp_instr(kinds, F.lit(WRONG))
    rows = rows.withColumns({"kinds": kinds, "at": at}).withColumns({"unit": F.substring("kinds", F.col("at"), F.lit(1)), "next": F.substring("kinds", F.col("at") + 1, F.lit(1))})
    unit, after = F.col("unit"), F.col("next")
    first = F.when(unit == "O", F.col("_read.cut"))
    for letter, name in ERRORS.items():
        first = first.when(unit == letter, name)
    first = first.when(after == "", "DANGLING_MODIFIER").when(after.isin("C", "P"), "CONSECUTIVE_MODIFIERS").when(after.isin("T", "I", "O"), "LITERAL_AFTER_MODIFIER").otherwise("MODIFIER_ON_DIRECT")
    first = F.when(F.col("at") > 0, first)
    size = F.col("_read.size")
    odd = F.when(F.col("_read.parsed") != size, "ODD_LENGTH")
    rows = rows.withColumn("first", first).withColumn("odd", odd)
    error = F.when(F.col("first") == "DANGLING_MODIFIER", F.coalesce("odd", "first")).otherwise(F.coalesce("first", "odd"))
    rows = rows.withColumn("error", error).withColumn("text", F.when(F.col("error").isNull(), F.col("_read.text")))
    sizes = [size.cast("long").alias("encoded_bytes"), F.char_length("text").cast("long").alias("decoded_characters"), F.octet_length("text").cast("long").alias("decoded_utf8_bytes")]
    counters = {"lexical_items": "LU", "direct_items": "OEFRXSWD", "literal_items": "TI", "modifier_items": "CP", "explicit_whitespace_items": "W"}
    counted = [letters(F.col("kinds"), which).cast("long").alias(n) for n, which in counters.items()]
    return rows.select(key, *columns, "text", "error", *sizes, *counted, F.regexp_count("kinds", F.lit(GAP)).cast("long").alias("reconstructed_implicit_spaces"))


def decode_strict(encoded: DataFrame, dictionary: DataFrame, key: str = "doc_id") -> DataFrame:
    """decode() that fails the job on the first bad stream."""
    out = decode(encoded, dictionary, key)
    return out.withColumn("text", F.when(F.col("error").isNull(), F.col("text")).otherwise(F.raise_error(F.concat_ws(": ", F.col(key).cast("string"), "error")).cast("string")))
