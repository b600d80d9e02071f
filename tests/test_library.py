"""Curation, evaluation, markup, sources, sinks, streaming and the registered queries on small data."""

import bz2
import hashlib
import re
import time

import pytest
from pyspark.sql import functions as F

from glyphmill.functions import text
from glyphmill.operators import codec, curation, dictionary, evaluate, tokens, wikitext
from glyphmill.plans.oracles import ORACLES
from glyphmill.plans.queries import QUERIES
from glyphmill.sources import readers, writers

SF = "/root/testdata/sf0.001"


def one(spark, column, **values):
    kinds = ", ".join(f"{k} {'long' if isinstance(v, int) else 'string'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], kinds).select(column).first()[0]


@pytest.fixture(scope="module")
def words(spark):
    return spark.createDataFrame([(1, 536, "hola", 2), (2, 537, "mundo", 1)], "ranking int, token int, word string, frequency long").cache()


def test_markup_rules():
    assert wikitext.without_tables("a{| x {| y |} z |}b") == "a\nb" and wikitext.without_tables("a {| b") == "a {| b" and wikitext.without_tables("a |} b") == "a |} b"
    for inside, want in (("lang|la|agri", "agri"), ("siglo|XX", "siglo XX"), ("unidad|3|km", "3 km"), ("Ficha de x|a=b", ""), ("cita web|u", ""), ("sfn|a", ""), ("x|k=v", "v"), ("x|a|b", ""), ("lang", "")):
        assert wikitext.template_text(inside) == want, inside
    for inside, want in (("A|b c", "b c"), ("A#s", "A"), ("File:x.png|thumb", ""), ("Categoría:X", "")):
        assert wikitext.link_text(inside) == want
    deep = "x"
    for k in range(12):
        deep = f"[[{k}|{deep}]]"
    assert wikitext.plain(deep) == "x" and wikitext.plain_or_same("[[A]]") == "A"
    assert wikitext.plain("{{x|{{lang|la|uno}}}} [[B|c]] [http://a.b t u] &amp; <b>d</b>") == "uno c t u & d"


def test_clean(spark):
    raw = "== T ==\r\n* '''a''' <!-- n -->\n{| q |}\n  # b<ref name=\"x\">y</ref><ref name=z/> c  \n\n\n\n: d {{siglo|V}} [[Archivo:f.png]]"
    got = one(spark, wikitext.clean(F.col("t")), t=raw)
    assert got.text == "T\na\nb c\nd siglo V" and got.removed_characters == len(raw) - len(got.text) and got.original_characters == len(raw)
    assert one(spark, wikitext.clean(F.col("t")), t="").reduction_ratio == 0.0


def test_names(spark):
    assert one(spark, text.identifier(F.col("t")), t="Anatomía  Clínica (2ª).PDF") == "ANATOMIA_CLINICA_2A"
    assert one(spark, text.family_key(F.col("t")), t="x/Atlas de Anatomía 3a EDICION parte 2 ilustrada.pdf") == "ATLAS DE ANATOMIA"
    assert one(spark, text.spaced_hex(F.encode("t", "UTF-8")), t="ab") == "61 62"
    assert one(spark, text.visible(F.col("t"), True), t="a\\\t\r\n") == "a\\\\\\t\\r\\n"
    assert one(spark, text.elapsed(F.col("t")), t=3723) == "01:02:03"
    assert one(spark, text.duplicate_form(F.col("t")), t=" café \t b\r\n\r\nc ") == "café b\nc"
    assert one(spark, text.strip(F.col("t")), t=" a\x1f") == "a"
    d = one(spark, text.first_difference(F.col("a"), F.col("b")), a="abc", b="abcd")
    assert (d["index"], d.left, d.right) == (3, None, "d") and one(spark, text.first_difference(F.col("a"), F.col("b")), a="x", b="x") is None


def test_manifest_dedup(spark):
    rows = [("b/X.pdf", b"one"), ("a/x.pdf", b"one"), ("c.pdf", b"one  "), ("d.pdf", b" "), ("e.pdf", b"two")]
    out = curation.dataset_manifest(spark.createDataFrame(rows, "path string, content binary"), "path", "content", F.decode("content", "UTF-8"))
    assert {r.path: (r.status, r.duplicate_of) for r in out.collect()} == {"a/x.pdf": ("EXTRACTED", None), "b/X.pdf": ("BINARY_DUPLICATE", "a/x.pdf"), "c.pdf": ("TEXT_DUPLICATE", "a/x.pdf"), "d.pdf": ("NO_TEXT", None), "e.pdf": ("EXTRACTED", None)}


def test_selection_and_resume(spark):
    rows = spark.createDataFrame([(k, f"w{k}.pdf", "EXTRACTED" if k != 2 else "ERROR") for k in range(1, 7)], "k int, path string, status string")
    out = curation.selection(rows, "k", "path", F.lit("anat"), excluded=(2,)).orderBy("candidate_order").collect()
    assert [(r.candidate_order, r.work_id, r.selected) for r in out] == [(1, "ANAT_001_W1", "YES"), (2, "ANAT_002_W3", "NO"), (3, "ANAT_003_W4", "YES"), (4, "ANAT_004_W5", "YES"), (5, "ANAT_005_W6", "YES")]
    assert [r.k for r in curation.invalid_exclusions(rows, "k", spark.createDataFrame([(2,), (3,), (9,)], "k int")).orderBy("k").collect()] == [2, 9]
    done = curation.latest(spark.createDataFrame([("1", "a", 1), ("1", "b", 2), ("x", "c", 3)], "k string, v string, at int"), "k", "at")
    assert [(r.k, r.v) for r in done.collect()] == [(1, "b")] and curation.pending(rows, done, "k").count() == 5
    with pytest.raises(ValueError, match="wanted 9"):
        curation.require_count(curation.skip_take(rows, 2, 9, "k"), 9)
    listing = spark.createDataFrame([("/d/extracted_text/w1.pdf",), ("w2.pdf",)], "path string")
    assert {r.k: r.resolved for r in curation.resolved_paths(rows, listing, "path", "/r", "/d").collect()} == {1: "/d/extracted_text/w1.pdf", 2: "w2.pdf", 3: None, 4: None, 5: None, 6: None}


def test_dump_and_funnel(spark, tmp_path):
    page = "<page><title>{0}</title><ns>{1}</ns><id> {2} </id>{3}<revision><text>{4}</text></revision></page>"
    pages = [("A", 0, 1, "", "'''hola''' mundo"), ("B", 1, 2, "", "x"), ("C", 0, 3, '<redirect title="A"/>', "x"), ("D", 0, 4, "", "  "), ("E", 0, 5, "", "{{sfn|x}}"), ("F", 0, "", "", "y")]
    body = '<mediawiki xmlns="http://www.mediawiki.org/xml/export-0.11/">' + "".join(page.format(*p) for p in pages) + "</mediawiki>"
    (tmp_path / "dump.xml.bz2").write_bytes(bz2.compress(body.encode()))
    rows = curation.article_stage(readers.dump(spark, f"{tmp_path}/dump.xml.bz2"))
    assert {r.stage: r.n for r in curation.funnel(rows).collect()} == {"ACCEPTED": 1, "OTHER_NAMESPACE": 1, "REDIRECT": 1, "NO_WIKITEXT": 1, "EMPTY_AFTER_CLEANING": 1, "NO_ID": 1}
    assert rows.where("stage = 'ACCEPTED'").first().cleaned.text == "hola mundo"


def test_manifest_dedup_reads_files_once(spark, tmp_path):
    spark.createDataFrame([("a.pdf", b"one"), ("b.pdf", "dös".encode())], "path string, content binary").write.parquet(f"{tmp_path}/files")
    out = curation.dataset_manifest(spark.read.parquet(f"{tmp_path}/files"), "path", "content", F.decode("content", "UTF-8"))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Python" not in plan and "content" not in plan and out.count() == 2


def test_numbers_of_nulls_and_ties(spark):
    rows = spark.createDataFrame([(k, o) for k, o in enumerate((2, 1, None, 2, 1_000_000))], "k long, o long")
    out = sorted((r.n, r.o) for r in curation.numbered(rows, "o").collect())
    assert [n for n, _ in out] == [1, 2, 3, 4, 5] and [o for _, o in out] == [1, 2, 2, 1_000_000, None]
    assert curation.numbered(rows.where("k < 0"), "o").count() == 0
    skewed = spark.range(3000).select(F.when(F.col("id") < 2900, 7).otherwise(F.col("id") * F.col("id")).alias("o"))
    assert sorted(r.n for r in curation.numbered(skewed, "o").collect()) == list(range(1, 3001))


def test_token_problems(spark):
    rows = [("ab c", [("ab", 0, 2), (" ", 2, 3), ("c", 3, 4)], None), ("ab", [("ab", 0, 2), ("c", 2, 3)], "CONTENT"), ("ab", [], "COVERAGE"), ("", [], None), (None, None, None), ("ab", [("a", 0, 1), ("b", 0, 2)], "GAP"), ("ab", [("a", 0, 0)], "RANGE"), ("ab", [(None, 0, 1)], "EMPTY_TOKEN")]
    df = spark.createDataFrame(rows, "text string, tokens array<struct<token: string, start: int, end: int>>, want string")
    assert all(r.got == r.want for r in df.select("want", tokens.token_problem(F.col("text"), F.col("tokens")).alias("got")).collect())


def test_pdf_text(spark, tmp_path):
    """With a stand-in for the PDF package: pages are joined, empty ones kept or not, and a broken file is a row's status."""
    (tmp_path / "pypdf.py").write_text("class Page:\n    def __init__(self, t): self.t = t\n    def extract_text(self): return self.t\nclass PdfReader:\n    def __init__(self, f, strict):\n        data = f.read().decode()\n        if data == 'bad': raise ValueError('broken')\n        self.pages = [Page(t) for t in data.split('|')]\n")
    spark.sparkContext.addPyFile(f"{tmp_path}/pypdf.py")
    (tmp_path / "in").mkdir()
    for name, data in (("a.pdf", "one||two"), ("B.PDF", " | "), ("c.Pdf", "bad"), ("d.txt", "no")):
        (tmp_path / "in" / name).write_text(data)
    found = readers.pdf_files(spark, f"{tmp_path}/in")
    rows = {r.path.rsplit("/", 1)[1]: r for r in readers.pdf_text(found).collect()}
    assert {k: (r.text, r.pages, r.pages_with_text, r.status) for k, r in rows.items()} == {"a.pdf": ("one\ntwo", 3, 2, "EXTRACTED"), "B.PDF": ("", 2, 0, "NO_TEXT"), "c.Pdf": (None, 0, 0, "ERROR")}
    assert "broken" in rows["c.Pdf"].error
    assert readers.pdf_text(found.where("path like '%a.pdf'"), keep_empty_pages=True).first().text == "one\n\ntwo"


def test_first_difference_of_long_texts(spark):
    long = "xy" * 100_000
    d = one(spark, text.first_difference(F.col("a"), F.col("b")), a=long + "a", b=long + "b")
    assert (d["index"], d.left, d.right) == (200_000, "a", "b")


def test_dictionary_files(spark, tmp_path, words):
    (tmp_path / "Words_20_x.csv").write_text("﻿Ranking,Token,Palabra,Frecuencia\n1,536, hola ,2\n2,537,mundo,\n", encoding="utf-8")
    (tmp_path / "other.csv").write_text("a\n1\n")
    rows = readers.dictionary(spark, f"{tmp_path}/Words_20_x.csv")
    assert [tuple(r) for r in rows.collect()] == [(1, 536, "hola", 2), (2, 537, "mundo", None)] and dictionary.validate(rows).first().error is None
    assert [(r.name, r.requested) for r in readers.dictionary_files(spark, str(tmp_path), "words").collect()] == [("Words_20_x.csv", 20)]
    with pytest.raises(ValueError, match="Palabra"):
        readers.dictionary(spark, f"{tmp_path}/other.csv")
    writers.dictionary(words, f"{tmp_path}/out")
    assert readers.dictionary(spark, f"{tmp_path}/out").collect() == words.collect()
    with pytest.raises(Exception, match="not in the dictionary"):
        dictionary.require(spark.createDataFrame([("nada",)], "word string"), words).collect()


def test_manifests_and_texts(spark, tmp_path):
    (tmp_path / "m.csv").write_text("CandidateOrder,ExtractionStatus,Selected\n2,extracted ,YES\n1,EXTRACTED,no\n3,ERROR,yes\n2,ERROR,YES\nx,ERROR,NO\n")
    assert sorted(r.CandidateOrder for r in readers.extraction_manifest(spark, f"{tmp_path}/m.csv").collect()) == [1, 2]
    assert [r.CandidateOrder for r in readers.selected(spark, f"{tmp_path}/m.csv").collect()] == [2, 2, 3]
    assert {r.CandidateOrder: r.ExtractionStatus for r in readers.checkpoint(spark, f"{tmp_path}/m.csv").collect()} == {1: "EXTRACTED", 2: "ERROR", 3: "ERROR"}
    (tmp_path / "t").mkdir()
    (tmp_path / "t/a.txt").write_bytes("uno\r\ndós\r".encode())
    assert readers.texts(spark, f"{tmp_path}/t").first().text == "uno\ndós\n"
    assert readers.raw_texts(spark, f"{tmp_path}/t").first().text == "uno\r\ndós\r"
    (tmp_path / "t/B.PDF").write_bytes(b"%PDF")
    assert readers.pdf_files(spark, f"{tmp_path}/t").count() == 1
    (tmp_path / "m.jsonl").write_text('{"selection_order": 1, "page_id": "7"}\n\n')
    assert readers.json_manifest(spark, f"{tmp_path}/m.jsonl").first().page_id == "7"
    writers.json_manifest(spark.range(2), f"{tmp_path}/j")
    with pytest.raises(Exception, match="exists"):
        writers.json_manifest(spark.range(2), f"{tmp_path}/j")


def test_report_and_upsert(spark, words, tmp_path):
    docs = spark.createDataFrame([(1, "Hola mundo.", "a"), (2, "hola  x", "a"), (3, "", "b")], "doc_id long, text string, lang string")
    rows = evaluate.round_trip(docs, words, "doc_id", "lang")
    assert {r.outcome for r in rows.collect()} == {"OK"} and evaluate.worst(rows).count() == 0
    out = {r.dataset: r for r in evaluate.report(rows, words, "mini", F.col("lang"), "lang").collect()}
    assert out["a"].documents_evaluated == 2 and out["a"].encoded_bytes == 8 + 2 + 4 + 5 and out["b"].reduction_percentage == 0.0 and out["a"].result == "OK"
    new = spark.createDataFrame([("d", 2, "a", 5)], "dictionary string, dictionary_size int, dataset string, n int")
    old = spark.createDataFrame([("d", 2, "a", 1), ("d", 1, "a", 2)], new.schema)
    assert [r.n for r in evaluate.upsert(old, new).collect()] == [2, 5]
    assert writers.upsert_csv(spark, old, None, f"{tmp_path}/1") == "INSERTED" and writers.upsert_csv(spark, new, f"{tmp_path}/1", f"{tmp_path}/2") == "UPDATED"
    assert sorted(r.n for r in readers.headed(spark, f"{tmp_path}/2").collect()) == ["2", "5"]
    with pytest.raises(ValueError, match="columns"):
        evaluate.upsert(old, new.drop("n"))


def test_decoder_checks_case_pairs(spark):
    words = spark.createDataFrame([(1, 536, "kelvin", 1)], "ranking int, token int, word string, frequency long")
    docs = spark.createDataFrame([(1, "Kelvin"), (2, "Kelvin")], "doc_id long, text string")
    assert evaluate.collisions(codec.encode(docs, words), docs).count() == 0


def test_stream(spark, words, tmp_path):
    from glyphmill.streaming.codec import encode_stream

    source = spark.createDataFrame([(k, f"Hola mundo {k}") for k in range(20)], "doc_id long, text string").repartition(4)
    source.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(source.schema).option("maxFilesPerTrigger", 2).parquet(f"{tmp_path}/in")
    encode_stream(stream, words, f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination()
    out = spark.read.parquet(f"{tmp_path}/out")
    assert out.count() == 20 and out.select("batch").distinct().count() > 1
    assert {r.text for r in codec.decode(out, words).collect()} == {f"Hola mundo {k}" for k in range(20)}


def test_published_figures(spark):
    """Sizes known for this table and a dictionary of its 20,000 most frequent words."""
    out = {r.lang: (r.documents, r.characters, r.utf8_bytes, r.encoded_bytes, r.lexical_items, r.direct_items, r.literal_items, r.literal_payload_bytes, r.implicit_spaces, r.explicit_single_spaces, r.explicit_whitespace_items, r.modifier_items) for r in QUERIES["compression_by_lang"](spark, SF).collect()}
    rows = spark.read.parquet(f"{SF}/documents.parquet")
    assert sum(v[0] for v in out.values()) == rows.count()
    assert sum(v[2] for v in out.values()) == rows.agg(F.sum(F.octet_length("text"))).first()[0]
    for v in out.values():
        assert v[3] >= 2 * (v[4] + v[5] + v[11] + v[9]) + 4 * v[6] + v[7]


def test_entry(spark):
    import __spark_entry__ as entry

    assert set(ORACLES) <= set(QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", [
        "token_type_counts", "compression_by_lang", "decode_stats", "normalized_text_dedup", "coverage_rollup", "token_validate", "dict_validate", "collision_pairs", "first_difference", "decode_errors", "clean_ratio", "postprocess_text",
        "table_strip", "template_rules", "link_rewrite", "numbered_with_gaps", "name_templates", "dump_file", "manifest_file", "selection_file", "checkpoint_file", "text_files", "text_status", "file_manifest_check", "upsert_file",
    ])
def test_queries_against_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "conversations", "labels", "pages", "nation"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got = QUERIES[name](spark, SF)
    want = con.sql(ORACLES[name])
    names = sorted(got.columns)
    assert names == sorted(want.columns)
    quoted = ", ".join(f'"{n}"' for n in names)
    plain = lambda rows: sorted(repr(tuple(round(float(v), 6) if isinstance(v, (int, float)) and not isinstance(v, bool) else v for v in r)) for r in rows)
    assert plain(got.select(*names).collect()) == plain(con.sql(f"select {quoted} from ({ORACLES[name]})").fetchall())


def test_one_word_class_per_character(spark):
    rows = spark.createDataFrame([("a",), ("́",), ("1",), ("ñ",)], "c string").select(text.is_letter(F.col("c")), text.is_mark(F.col("c")), text.continues_word(F.col("c")))
    assert [tuple(r) for r in rows.collect()] == [(True, False, True), (False, True, True), (False, False, False), (True, False, True)]
    assert [r.token for r in tokens.tokenize(spark.createDataFrame([("á 1",)], "text string")).orderBy("pos").collect()] == ["á", " ", "1"]


def long_texts(spark, at):
    texts = ["word " * 60 + "\tend\r\n\u00fc\u20ac", "a\tb", "x" * 300 + "<!-- far --> kept <ref name=\"r\">gone</ref> <math>m</math> tail"]
    spark.createDataFrame([(k, t, "en", len(t)) for k, t in enumerate(texts)], "doc_id long, text string, lang string, n_chars long").write.parquet(f"{at}/documents.parquet")
    return texts


def test_whole_renderings(spark, tmp_path):
    texts = long_texts(spark, tmp_path)
    out = {r.doc_id: r for r in QUERIES["renderings"](spark, str(tmp_path)).collect()}
    for k, t in enumerate(texts):
        shown = t.replace("\t", "\\t").replace("\r", "\\r").replace("\n", "\\n")
        assert out[k].visible_sha256 == hashlib.sha256(shown.encode()).hexdigest()
        assert out[k].hex_sha256 == hashlib.sha256(t.encode().hex(" ").upper().encode()).hexdigest()


def test_whole_markup(spark, tmp_path):
    texts = long_texts(spark, tmp_path)
    wrapped = [f"== en ==\r\n* '''{t}''' <!-- note -->\n{{| a\n| b {{| c |}} |}}\n  # tail<ref name=\"x\">y</ref> <math>z</math>   end  \n\n\n\n: last" for t in texts]
    out = {r.doc_id: r.text for r in QUERIES["comments_and_tags"](spark, str(tmp_path)).collect()}
    assert [out[k] for k in range(3)] == [re.sub(r"(?s)<!--.*?-->|<ref\b[^<>]*>.*?</ref>|<math>.*?</math>", "", w) for w in wrapped]
    ratio = {r.doc_id: r for r in QUERIES["clean_ratio"](spark, str(tmp_path)).collect()}
    assert [ratio[k].original_characters for k in range(3)] == [len(w) for w in wrapped]
    assert ratio[2].cleaned_characters - ratio[1].cleaned_characters == len("x" * 300 + " kept tail") - len("a b")
    assert all(r.original_characters - r.cleaned_characters == r.removed_characters for r in ratio.values())


def test_tokens_of_a_long_text_take_linear_time(spark):
    df = spark.createDataFrame([("ab, " * 100_000,)], "text string").withColumn("tokens", tokens.placed(F.col("text")))
    began = time.monotonic()
    out = df.select(F.size("tokens").alias("n"), F.element_at("tokens", -1).alias("last"), tokens.token_problem(F.col("text"), F.col("tokens")).alias("error")).first()
    assert (out.n, out.error, tuple(out.last)) == (300_000, None, (" ", 399_999, 400_000)) and time.monotonic() - began < 30


def test_first_token_problem_counts(spark):
    rows = [
        ("abc", [("a", 0, 1), ("x", 1, 2), ("c", 5, 6)], "CONTENT"), ("abc", [("a", 0, 1), ("b", 5, 6), ("x", 6, 7)], "GAP"), ("abc", [("a", 0, 1), ("bc", 1, 2)], "CONTENT"), ("abc", [("x", 0, 1), ("", 1, 2)], "CONTENT"),
        ("ab", [("ab", 0, 5)], "COVERAGE"), ("ab", [("ab", 0, 5), ("c", 5, 6)], "CONTENT"), ("ab", [("a", 0, None)], "RANGE"), ("ab", [("a", None, 1)], "GAP"), ("ab", [None], "EMPTY_TOKEN"),
    ]
    df = spark.createDataFrame(rows, "text string, tokens array<struct<token: string, start: int, end: int>>, want string")
    assert [(r.text, r.got) for r in df.select("text", tokens.token_problem(F.col("text"), F.col("tokens")).alias("got")).collect()] == [(t, w) for t, _, w in rows]


def test_a_round_trip_is_one_pass(spark):
    docs = spark.createDataFrame([(1, "hola"), (1, "Hola mundo"), (2, None)], "doc_id long, text string")
    words = spark.createDataFrame([(1, 536, "hola", 2)], "ranking int, token int, word string, frequency long").cache()
    rows = evaluate.round_trip(docs, words)
    assert sorted((r.doc_id, r.text or "", r.outcome) for r in rows.collect()) == [(1, "Hola mundo", "OK"), (1, "hola", "OK"), (2, "", "OK")]
    lines = [line for line in rows._jdf.queryExecution().optimizedPlan().toString().split("\n") if not line.lstrip().startswith(":")]
    assert not any("Join" in line for line in lines)


def test_collisions_move_digests_only(spark):
    docs = spark.createDataFrame([(1, "hola"), (2, None)], "doc_id long, text string")
    words = spark.createDataFrame([(1, 536, "hola", 2)], "ranking int, token int, word string, frequency long").cache()
    lines = evaluate.collisions(codec.encode(docs, words), docs)._jdf.queryExecution().executedPlan().toString().split("\n")
    moved = [lines[k + 1] for k, line in enumerate(lines) if re.search(r"Exchange hashpartitioning\(doc_id|BroadcastExchange HashedRelationBroadcastMode\(List\(input\[0, bigint", line)]
    assert moved and all("sha2(" in line for line in moved)


@pytest.mark.parametrize("name", ["decode_errors", "decode_stats"])
def test_decoding_queries_take_documents_whole(spark, name):
    lines = [line for line in QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString().split("\n") if not line.lstrip().startswith(":")]
    assert not any(node in line for line in lines for node in ("Generate", "Window", "Aggregate", "Join", "AS _table#"))


@pytest.mark.parametrize("name", ["decode_errors", "decode_stats"])
def test_decoding_queries_code_over_arrow_batches(spark, name):
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 2
