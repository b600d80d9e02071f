"""URL rules, WARC archives, pseudonyms, toxicity and the pipeline."""

import datetime
import hashlib
import random
import re

import pytest
from helpers import awkward, frame, prose
from pyspark.sql import functions as F

from glyphmill.llm import pii, toxicity, urlfilter, warc
from glyphmill.llm.common import written


def brute_rule(url, rules, default):
    if url is None or "://" not in url:
        return "", "", None, default
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host, best = "".join(c.lower() if c.isascii() else c for c in host), None
    for verdict, rule in rules:
        h, slash, p = rule.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith(slash + p):
            rank = (h.count(".") + 1, len(slash + p))
            if best is None or rank > best[0]:
                best = (rank, rule, verdict)
    return host, path, best and best[1], best[2] if best else default


URLS = [None, "", "example.net/en/", "http://example.net/en/", "http://EXAMPLE.net/en/x?y#z", "https://a.example.net/de/", "http://b.net", "http://b.net/", "http://b.net?/en/", "x://org/fr/a", "x://www.org/fr", "http://example.com/de/1", "http://notexample.com/de/1", "http://example.com/de", "http:///de/", "a://b://c/d", "http://example.net:80/en/", "http://x.org/fr/\n?"]


@pytest.mark.parametrize("block_bytes", [1 << 20, 1])
def test_url_rules(spark, block_bytes):
    rules = [*urlfilter.RULES, ("block", "org/fr/pre"), ("allow", "x.org/"), ("block", "example.net/en/a/b")]
    urls = [*URLS, "http://x.org/fr/prefix", "http://y.org/fr/prefix/1", "http://example.net/en/a/bc", "http://example.net/en/a/c"]
    pages = spark.createDataFrame([(k, u, "kept") for k, u in enumerate(urls)], "page_id long, url string, rule string")
    for chosen in (urlfilter.RULES, rules):
        out = urlfilter.judged(pages, chosen, block_bytes=block_bytes)
        assert {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in out.collect()} == {k: brute_rule(u, chosen, "allow") for k, u in enumerate(urls)}
    assert urlfilter.judged(pages.where("false")).count() == 0


def test_warc(spark, tmp_path):
    rng = random.Random(2)
    long = prose(rng, 30_000)
    rows = [(k, f"http://a.net/{k} ü\r\n", t) for k, t in enumerate([long, "x", None, "", long, "\r\n\r\n0\r\n\r\n", "é" * 9000, "x", long + "."])] + [(1, "again", "x"), (None, None, "only"), (None, None, "x")]
    pages = spark.createDataFrame([(*r, "extra") for r in rows], "page_id long, url string, html string, digest string").repartition(3)
    paths = warc.archived(pages, f"file://{tmp_path}/warc", segment_bytes=5000, archive_bytes=30_000)
    assert paths.count() > 2
    out = warc.read_back(paths).collect()
    first = {}
    for k, _, t in rows:
        if k is not None:
            first[t or ""] = min(k, first.get(t or "", 1 << 60))
    want = sorted(((k, len((t or "").encode()), warc.base32((t or "").encode()), "response" if first.get(t or "") == k else "revisit", None if first.get(t or "") == k else first.get(t or "")) for k, _, t in rows), key=repr)
    got = sorted(((r.page_id, r.payload_bytes, r.digest, r.kind, r.refers_to if r.kind == "revisit" else None) for r in out), key=repr)
    assert got == want and all(r.problem is None for r in out)
    none = warc.read_back(warc.archived(pages.where("false"), f"file://{tmp_path}/none"))
    assert none.count() == 0


def test_warc_faults():
    block = warc.HTTP + warc.chunked(b"hello" * 5000)
    rows = [("o", k + 1, len(block) if k == 2 else None, "response" if not k else "continuation", 7, None, warc.base32(b"hello" * 5000), None, p, None) for k, p in enumerate((block[:9000], block[9000:20000], block[20000:]))]
    assert warc.whole(rows)[7:] == (25000, None, None)
    assert warc.whole([rows[0], rows[2]])[9] == "segments missing or repeated"
    assert warc.whole([*rows[:2], (*rows[2][:2], 5, *rows[2][3:])])[9] == "total length differs"
    assert warc.whole([*rows[:2], (*rows[2][:8], rows[2][8].replace(b"h", b"H"), None)])[9] == "payload digest differs"
    assert warc.dechunked(b"3;x=y\r\nabc\r\n0\r\nTrailer: 1\r\n\r\n") == b"abc" and warc.dechunked(warc.chunked(b"")) == b""


PRIVATE = {
    "card": ["4111111111111111", "4111 1111 1111 1111", "3782-822463-10005", "6011000990139424"], "iban": ["DE89370400440532013000", "GB29 NWBK 6016 1331 9268 19"], "ip": ["97.51.17.173", "8.8.8.8", "255.1.2.3"],
    "phone": ["+1 (017) 555-7713", "(212) 555-0199", "+49 30 123456", "+442079460958"], "ssn": ["078-05-1120"], "date": ["2024-02-29", "31/12/1999", "12/31/1999", "1.2.2003", "01.02.2003"], "email": ["und.34@mail7.example.com", "A.b+c@x.org"],
}


def test_pseudonyms_keep_format():
    p = pii.Permutation(b"key")
    back = pii.Permutation(b"key")
    back.back = True
    for kind, values in PRIVATE.items():
        for v in values:
            text = f"see {v}, or {v} again"
            out, seen = pii.pseudonymised(text, p)
            new = out[4 : out.index(", or ")]
            assert seen[kind] == 2 == sum(seen.values()) and new != v and out == f"see {new}, or {new} again", (v, out)
            if kind != "ip" and v != "1.2.2003":
                assert re.sub(r"[A-Za-z]", "a", re.sub(r"\d", "9", new)) == re.sub(r"[A-Za-z]", "a", re.sub(r"\d", "9", v))
            if kind == "card":
                d = re.sub(r"\D", "", new)
                assert pii.luhn(d[:-1]) == int(d[-1])
            if kind == "iban":
                s = new.replace(" ", "")
                assert pii.mod97(s[4:] + s[:4]) == 1
            if kind == "date" and "-" in v:
                datetime.date.fromisoformat(new)
            assert pii.pseudonymised(out, back)[0] == text, (v, out)
    assert pii.pseudonymised("4111 1111 1111 1111", p)[0].replace(" ", "") == pii.pseudonymised("4111111111111111", p)[0]


def test_forms_of_one_value_stay_linked():
    p = pii.Permutation(b"key")
    new = lambda text: pii.pseudonymised(text, p)[0]
    iso, slashed, dotted, american = (new(t) for t in ("2020-12-25", "25/12/2020", "25.12.2020", "12/25/2020"))
    y, m, d = iso.split("-")
    assert (slashed, dotted, american) == (f"{d}/{m}/{y}", f"{d}.{m}.{y}", f"{m}/{d}/{y}") and iso != "2020-12-25"
    y, m, d = new("2021-03-04").split("-")
    assert new("4.3.2021") == f"{int(d)}.{int(m)}.{y}" and new("04/03/2021") == f"{d}/{m}/{y}"
    digits = lambda text: "".join(c for c in new(text) if c.isdigit())[-10:]
    assert digits("+1 555 123 4567") == digits("(555) 123-4567") == digits("+15551234567") != "5551234567"


def test_values_among_other_words_and_numbers():
    p, back = pii.Permutation(b"key"), pii.Permutation(b"key")
    back.back = True
    ibans = ["ES91 2100 0418 4502 0005 1332", "BE68 5390 0754 7034", "DE89 3704 0044 0532 0130 00"]
    for value, kind, after in [(v, "iban", a) for v in ibans for a in (" BIC CAIXESBB", " EUR", " TOTAL 1200 EUR", "")] + [(v, "phone", a) for v in ("+33 1 23 45 67 89", "+33 6 12 34 56 78", "+44 20 7 946 0958", "+33123456789") for a in ("", ", and")]:
        text = f"to {value}{after}"
        out, seen = pii.pseudonymised(text, p)
        assert seen[kind] == 1 == sum(seen.values()) and out.endswith(after) and out[3 : 3 + len(value)] != value, text
        assert pii.pseudonymised(out, back)[0] == text
    two = "BE68 5390 0754 7034 BE68 5390 0754 7034"
    out, seen = pii.pseudonymised(two, p)
    assert seen["iban"] == 2 and pii.pseudonymised(out, back)[0] == two and out[:19] == out[20:] != two[:19]
    out, seen = pii.pseudonymised("+33 6 12 34 56 78 1234 5678", p)
    assert seen["phone"] == 1 and out.endswith(" 5678")


def test_what_is_not_private_stays():
    p = pii.Permutation(b"key")
    for text in ("4111111111111112", "300.1.2.3", "1.2.3", "v1.2.3.4.5", "2023-02-30", "666-12-3456", "token = 1234567890", "a@b", "DE00370400440532013000", "0000000000000000", "x2024-01-01"):
        assert pii.pseudonymised(text, p) == (text, dict.fromkeys(pii.KINDS, 0)), text


def test_permutation_is_one():
    p = pii.Permutation(b"k")
    for n in (2, 7, 100, 1000):
        out = [p("x", n, k) for k in range(n)]
        assert sorted(out) == list(range(n)) and all(a != k for k, a in enumerate(out))


def test_pseudonyms_of_documents(spark):
    rows = awkward()
    rows[3] = (3, "mail und.34@mail7.example.com or +1 (017) 555-7713", "en", "a", 1)
    rows[4] = (4, "und.34@mail7.example.com", "en", "a", 1)
    docs = frame(spark, rows, extra=True).withColumn("n_ip", F.lit("clash"))
    out = pii.replaced(docs, b"key")
    texts = {r.doc_id: r.text for r in out.collect()}
    assert texts[4] in texts[3] and texts[4] != rows[4][1]
    assert out.where("doc_id = 3").first().n_phone == 1 and texts[65] is None and texts[66] == ""
    assert {r.doc_id: r.text for r in pii.restored(out, b"key").collect()} == {r[0]: r[1] for r in rows}
    assert pii.replaced(frame(spark, []), b"key").count() == 0


def labelled(spark, n=400):
    rng = random.Random(4)
    rows, labels = [], []
    for k in range(n):
        toxic = k % 5 == 0
        words = prose(rng, rng.randint(20, 80)).split()
        if toxic:
            for bad in rng.sample(["scumbag", "moronic", "vilething"], 2):
                words.insert(rng.randrange(len(words)), bad)
        rows.append((k, " ".join(words), "en", "a", 0))
        if k % 2 == 0:
            labels.append((k, 1, int(toxic)))
    rows += [(n, None, "en", "a", 0), (n + 1, "", "en", "a", 0), (None, "no id", "en", "a", 0)]
    return rows, [*labels, (None, 0, 1), (n + 7, 0, None), labels[0]]


def test_toxicity(spark):
    rows, labels = labelled(spark)
    docs, marks = frame(spark, rows, extra=True).drop("score"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = toxicity.trained(docs, marks)
    out = toxicity.scored(docs, model).withColumn("held_out", toxicity.fold(F.col("doc_id")) == 0)
    known = {k: t for k, _, t in labels}
    right = [(r.score >= 0.5) == bool(known[r.doc_id]) for r in out.collect() if r.held_out and known.get(r.doc_id) is not None]
    assert len(right) > 20 and sum(right) / len(right) > 0.95
    assert out.where("score is null or score < 0 or score > 1").count() == 0 and out.count() == len(rows)
    none = toxicity.scored(docs, toxicity.trained(docs, marks.where("toxic = 0")))
    assert none.where("score > 0").count() == 0
    assert toxicity.scored(frame(spark, []), model).count() == 0
    flipped = toxicity.trained(docs, marks.withColumn("toxic", F.when(toxicity.fold(F.col("doc_id")) == 0, 1 - F.col("toxic")).otherwise(F.col("toxic"))))
    assert (flipped.weight == model.weight).all()  # the held-out fold's labels are never read


def test_pipeline(spark, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    rows, labels = labelled(spark)
    rng = random.Random(9)
    base = prose(rng, 200)
    near = base.split()
    near[50] = "edited"
    item = prose(rng, 30)
    rows += [(1000, base, "en", "b", len(base)), (1001, base, "en", "b", len(base)), (1002, " ".join(near), "en", "b", 1), (1003, prose(rng, 20) + " " + item + " " + prose(rng, 9), "en", "b", 1), (1004, prose(rng, 50) + " write a.bee@example.com now", "en", "b", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, str(tmp_path)), name)
        kept[name] = {r.doc_id for r in docs.select("doc_id").collect()}
        if name != "mixing":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    toxic = set(range(0, 400, 5))
    clean = {r[0] for r in rows if r[0] is not None} - toxic
    assert len(toxic - kept["toxicity"]) >= 0.95 * len(toxic) and len(clean & kept["toxicity"]) >= 0.97 * len(clean)
    assert {1000, 1001, 1002} & kept["near_dedup"] == {1000} and 1003 in kept["near_dedup"]
    assert kept["near_dedup"] - kept["decontamination"] == {1003}
    assert kept["pii"] == kept["decontamination"]
    assert docs.where("text like '%a.bee@example.com%'").count() == 0 and docs.where("copy not in (1, 2)").count() == 0
    again = corpus_pipeline.run(spark, str(tmp_path))
    digest = lambda df: hashlib.sha256(repr(sorted(map(repr, df.collect()))).encode()).hexdigest()
    assert digest(again) == digest(docs)


def test_sieve(spark):
    from glyphmill.llm.common import sieve

    rng = random.Random(3)
    keys, others = ([(rng.randrange(-(1 << 63), 1 << 63),) for _ in range(2000)] for _ in range(2))
    keys += [(-1,), (0,), ((1 << 26) - 1,), (1 << 15,)]
    has = sieve(spark.createDataFrame(keys, "k long"), "k")
    assert spark.createDataFrame(keys, "k long").where(~has("k")).count() == 0
    assert spark.createDataFrame(others, "k long").where(has("k")).count() < 20
    assert spark.createDataFrame(keys, "k long").where(sieve(spark.createDataFrame([], "k long"), "k")("k")).count() == 0


def test_stages_with_awkward_input(spark, tmp_path):
    """Nulls, empty and long texts, repeated rows, columns named like the operators' own, and empty tables."""
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    clash = ["row", "node", "own", "root", "first", "score", "items", "n_words", "n_hit", "n_card", "hash", "copies", "each", "rate", "bits"]
    docs = frame(spark)
    for name in clash:
        docs = docs.withColumn(name, F.lit("mine"))
    docs.limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns + ["copy"] * (name == "mixing")
        kept = out.collect()
        assert kept and all(r[c] == "mine" for r in kept for c in clash)
        if name in ("toxicity", "decontamination", "pii"):
            assert len(kept) == docs.count()
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
