"""Operators over documents, against brute force."""

import hashlib
import random
import re
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from helpers import SCHEMA, awkward, frame, prose
from pyspark.sql import functions as F

from glyphmill.llm import decontamination, media, mixing, paragraphs, simhash, suffixes, words


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def counted(rows):
    return Counter(map(repr, rows))


# SimHash


def brute_fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
    h = [xxhash.xxh64_intdigest(" ".join(w[k : k + 3]).encode(), 42) for k in range(max(1, len(w) - 2))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(prints):
    ids = {}
    for k, f in prints:
        ids.setdefault(f, []).append(k)
    group = {f: f for f in ids}

    def root(f):
        while group[f] != f:
            f = group[f]
        return f

    for a in ids:
        for b in ids:
            if (a ^ b).bit_count() <= 3:
                group[root(a)] = root(b)
    least = {}
    for f, ks in ids.items():
        known = [k for k in ks if k is not None]
        r = root(f)
        least[r] = min([*known, *([least[r]] if least.get(r) is not None else [])], default=None)
    return {f: least[root(f)] for f in ids}


@pytest.mark.parametrize("block_rows", [8192, 3])
def test_simhash(spark, block_rows):
    rows = awkward()
    prints = [(r[0], brute_fingerprint(r[1])) for r in rows]
    least = brute_components(prints)
    out = simhash.grouped(frame(spark, rows, extra=True), block_rows=block_rows).collect()
    assert counted((r.doc_id, r.fp % (1 << 64), r.component_id) for r in out) == counted((k, f, least[f]) for k, f in prints)


def test_links_of_near_fingerprints(spark):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    near = [int(b) ^ sum(1 << int(x) for x in rng.choice(64, k, replace=False)) for b in base for k in (1, 2, 3, 4)]
    prints = list({int(b) for b in base} | set(near))
    want = brute_components([(k, f) for k, f in enumerate(prints)])
    fps = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in prints], "fp long")
    from glyphmill.llm.graph import components

    roots = {r.node % (1 << 64): r.root for r in components(simhash.links(fps, block_rows=16)).collect()}
    groups = lambda of: sorted(sorted(f for f in prints if of(f) == g) for g in {of(f) for f in prints})
    assert groups(lambda f: roots.get(f, f"alone {f}")) == groups(lambda f: want[f])


def test_golay_keys():
    of = simhash.Keys()
    rng = np.random.default_rng(1)
    a = rng.integers(0, 1 << 63, 500, dtype=np.uint64)
    flips = np.array([sum(1 << int(x) for x in rng.choice(64, 3, replace=False)) for _ in a], np.uint64)
    shared = 0
    for x, y in zip(a, a ^ flips, strict=True):
        kx, sx, _ = of(np.array([x]))
        ky, sy, _ = of(np.array([y]))
        shared += bool(set(kx[sx == 0]) & set(ky[sy == 1]))
    assert shared == len(a)
    assert all(len(simhash.golay(w)[1]) == 2048 for w in (21, 22, 23))


def test_components(spark):
    from glyphmill.llm.graph import components

    links = [(k, k + 1) for k in range(1, 60)] + [(100, 200), (300, 200), (5, 5)] + [(1000, k) for k in range(1001, 1200)]
    out = {r.node: r.root for r in components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert {out[k] for k in range(1, 61)} == {1} and out[300] == 100 and {out[k] for k in range(1000, 1200)} == {1000}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_near_duplicates_leave_one(spark):
    rows = awkward()
    out = simhash.deduplicated(frame(spark, rows, extra=True))
    kept = [r.doc_id for r in out.collect()]
    texts = {r[0]: r[1] for r in rows}
    assert out.columns == frame(spark, rows, extra=True).columns
    assert 60 in kept and 61 not in kept and 62 not in kept and kept.count(60) == 1  # a copy, a near copy, and repeated rows
    assert sum(not re.findall(r"\S+", texts.get(k) or "") for k in kept if k is not None) == 1
    clean = [k for k in range(60) if len((texts[k] or "").split()) > 20]
    assert set(clean) <= set(kept)
    assert simhash.deduplicated(frame(spark, [])).count() == 0


def test_near_duplicates_are_verified(spark):
    rng = __import__("random").Random(5)
    rows, want = [], set()
    for k in range(80):  # shared beginnings, so that pairs lie just above and just below 0.8
        a = [f"w{rng.random()}" for _ in range(200)]
        both = 176 + k % 5 - 2  # 200 words have 196 shingles; two texts share both - 4
        b = a[:both] + [f"v{rng.random()}" for _ in range(200 - both)]
        rows += [(2 * k, " ".join(a), "en", "a", 1), (2 * k + 1, " ".join(b), "en", "a", 1)]
        want |= {2 * k} if 1.8 * (both - 4) >= 0.8 * 2 * 196 - 1e-9 else {2 * k, 2 * k + 1}
    assert {r.doc_id for r in simhash.deduplicated(frame(spark, rows)).collect()} == want
    side, sets = np.full(9, 2), [np.unique(np.array(rng.sample(range(40), 30), np.uint64)) for _ in range(9)]
    pairs = list(zip(*simhash.similar_pairs(side, sets, 0.6, cells=27), strict=True))
    assert pairs == [(a, b) for a in range(9) for b in range(a + 1, 9) if len(np.intersect1d(sets[a], sets[b])) >= 0.6 * len(np.union1d(sets[a], sets[b]))]


def test_recall_of_near_duplicates(spark):
    """Edited copies of a few texts, against all pairs: links are exact, and at least 0.95 of the groups' links are found."""
    rng = __import__("random").Random(12)
    rows = []
    for g in range(30):
        base = [f"w{rng.randrange(5000)}" for _ in range(rng.randint(60, 400))]
        for _ in range(8):
            t = list(base)
            for _ in range(rng.randint(0, max(1, len(t) // 60))):
                t[rng.randrange(len(t))] = f"x{rng.random()}"
            rows.append((len(rows), " ".join(t), "en", "a", 1))
    rows += [(1000 + k, rows[3][1], "en", "a", 1) for k in range(50)]
    sets = {r[0]: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} for r in rows for w in [r[1].split()]}
    group = {k: k for k in sets}

    def root(k):
        while group[k] != k:
            k = group[k]
        return k

    pairs = [(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    for a, b in pairs:
        group[max(root(a), root(b))] = min(root(a), root(b))
    found = {r.node: r.root for r in simhash.named(frame(spark, rows)).select("node", "root").collect()}
    nodes = {r.doc_id: found.get(r.node, r.node) for r in frame(spark, rows).select("doc_id", F.xxhash64("text").alias("node")).collect()}
    assert all(root(a) == root(b) for a in nodes for b in nodes if nodes[a] == nodes[b])
    assert sum(nodes[a] == nodes[b] for a, b in pairs) >= 0.95 * len(pairs) and len(pairs) > 300


def test_profiles_hold_min_hashes(spark):
    h, first = words.shingle_sets(np.frombuffer(b"a b c d e f\n g  A B C Da b", np.uint8), np.array([0, 14, 14, 23, 26]), 3)
    assert np.diff(first).tolist() == [5, 0, 2, 1] and h[first[2]] in h[:5]
    least = simhash.min_hashes(h, first, 4, 1)
    assert (least[1] == np.iinfo(np.uint64).max).all() and len(set(least[0])) == 4
    assert (least[3] == simhash.min_hashes(h[-1:], np.array([0, 1]), 4, 1)[0]).all()


def test_near_duplicates_leave_one_of_each_group(spark):
    rng = __import__("random").Random(6)
    one, two, three = (prose(rng, 60) for _ in range(3))
    rows = [(k, t, "en", "a", 1) for k, t in ((1, one), (1, two), (2, one), (3, two), (None, three), (None, three + " more"))]
    out = [(r.doc_id, r.text[:20]) for r in simhash.deduplicated(frame(spark, rows)).collect()]
    assert counted(out) == counted([(1, one[:20]), (1, two[:20]), (None, three[:20])])


# Media


def test_media(spark, tmp_path):
    rows = awkward()
    docs = frame(spark, rows, extra=True)
    from glyphmill.llm.common import written

    stored = written(media.stored(docs, f"file://{tmp_path}/shards", shard_bytes=20_000), "media")
    found = {r.digest: r for r in media.measured(media.described(media.places(stored))).collect()}
    out = stored.collect()
    assert len(out) == len(rows)
    texts = Counter((t or "").encode() for _, t, *_ in rows)
    seen = Counter()
    for r in out:
        f = found[r.digest]
        assert f.payload_sha256 == r.digest and (f.width, f.bits, f.colour) == (64, 8, 0) and f.height * 64 == r.payload_bytes
        assert r.length == f.media_bytes
        seen[r.digest] += 1
    for text, n in texts.items():
        data = media.payload(text)
        digest = hashlib.sha256(data).hexdigest()
        assert len(data) % 64 == 0 and data and seen[digest] >= n
        assert found[digest].tail_crc32 == zlib.crc32(data[-64:]) and media.decoded(media.encoded(data)) == data
    import tarfile

    shards = sorted(tmp_path.glob("shards/*.tar"))
    assert len(shards) > 1
    with tarfile.open(shards[0]) as tar:
        for member in tar:
            assert hashlib.sha256(media.decoded(tar.extractfile(member).read())).hexdigest() == member.name.removesuffix(".png")
    assert media.stored(frame(spark, []), f"file://{tmp_path}/none").count() == 0


# Mixing


def test_mixing(spark):
    rows = awkward()
    docs = frame(spark, rows, extra=True)
    out = mixing.mixed(docs, bucket_rows=16).collect()
    sizes = Counter()
    for r in rows:
        sizes[r[3]] += len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or ""))
    order = sorted((s for s in sizes if s is not None)) + [None]
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    left, want, open_ = 1.5 * sum(sizes.values()), {}, set(order)
    while True:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > 2 * sizes[s]}
        if not over:
            want |= share
            break
        for s in over:
            want[s] = 2.0 * sizes[s]
            left -= want[s]
        open_ -= over
    taken = Counter()
    for r in out:
        assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6 * max(1, want[r.source]) and 0 <= r.copies <= 2
        taken[r.source] += r["size"] * r.copies
    assert len(out) == len(rows)
    for s in order:  # documents are whole: a source can be off by half its largest
        assert abs(taken[s] - want[s]) <= max(r["size"] for r in out if r.source == s) / 2, (s, taken[s], want[s])
    assert counted(out) == counted(mixing.mixed(docs, bucket_rows=16).collect())
    assert mixing.mixed(frame(spark, [])).count() == 0
    assert mixing.mixed(frame(spark, [(1, None, None, None, 0), (2, "", "en", "a", 0)])).where("copies is null").count() == 0


def test_mixing_with_overlapping_constraints(spark):
    """Sources and languages at once, held against the conditions of the optimum."""
    rng = np.random.default_rng(8)
    sources, langs, sizes = rng.choice(["a", "b", "c", "d"], 900, p=[0.5, 0.3, 0.15, 0.05]), rng.choice(["en", "de", "fr"], 900), rng.integers(1, 200, 900)
    rows = [(k, "w " * int(n), str(g), str(s), 0) for k, (n, g, s) in enumerate(zip(sizes, langs, sources, strict=True))]
    docs, total = frame(spark, rows), int(sizes.sum())
    goals = {"en": 0.36 * 1.5 * total, "de": 0.30 * 1.5 * total}
    moments = [(F.when(F.col("lang") == g, 1.0).otherwise(0.0), t) for g, t in goals.items()]
    out = mixing.mixed(docs, keys=("doc_id", "lang"), moments=moments, ridge=1e-6, bucket_rows=64).toPandas().sort_values("doc_id")
    size, rate, target = out["size"].to_numpy(), out["rate"].to_numpy(), out.groupby("source")["target"].first()
    for s, t in target.items():
        own = (out["source"] == s).to_numpy()
        assert abs((size * rate)[own].sum() / t - 1) < 1e-5
        assert abs((size * out["copies"].to_numpy())[own].sum() - t) <= 200 * (own.sum() // 64 + 1)
    for g, t in goals.items():
        assert abs((size * rate)[(out["lang"] == g).to_numpy()].sum() / t - 1) < 1e-3
    assert rate.max() <= 2 and len(np.unique(np.round(rate, 6))) > 6
    # the optimum: log(rate / (2 - rate)) is a source's multiplier plus a language's, but where a source is at its bound
    cell = out[out["rate"] < 2 - 1e-6].groupby(["source", "lang"])["rate"].first().unstack().map(lambda r: np.log(r / (2 - r)))
    assert np.nanmax(np.abs((cell["en"] - cell["fr"]) - (cell["en"] - cell["fr"]).mean())) < 1e-4
    assert sorted(out["rate"]) == sorted(mixing.mixed(docs, keys=("doc_id", "lang"), moments=moments, ridge=1e-6, bucket_rows=64).toPandas()["rate"])


def test_mixing_keeps_the_mean_length(spark):
    rng = np.random.default_rng(9)
    sources = rng.choice(["a", "b", "c"], 600, p=[0.2, 0.5, 0.3])
    sizes = np.where(sources == "a", rng.integers(100, 900, 600), rng.integers(1, 300, 600))
    rows = [(k, "w " * int(n), "en", str(s), 0) for k, (n, s) in enumerate(zip(sizes, sources, strict=True))]
    mean = lambda t, n: (t * np.log1p(n)).sum() / t.sum()
    corpus = mean(sizes, sizes)
    plain, kept = (mixing.mixed(frame(spark, rows), moments=m).toPandas() for m in ([], None))
    off = [abs(mean(p["size"] * p["rate"], p["size"]) - corpus) for p in (plain, kept)]
    assert off[1] < 0.5 * off[0], off  # the bound on rates leaves no more
    for p in (plain, kept):
        assert np.allclose((p["size"] * p["rate"]).groupby(p["source"]).sum(), p.groupby("source")["target"].first(), rtol=1e-5)


def test_copies_of_clashing_columns(spark):
    rows = [(k, f"word {k} " * 9, "en", f"s{k % 2}", 1) for k in range(8)]
    docs = frame(spark, rows)
    for name in ("row", "hash", "id", "of", "from", "each", "copies", "place", "copy"):
        docs = docs.withColumn(name, F.lit("mine"))
    out = mixing.copied(docs)
    assert out.columns == [*[c for c in docs.columns if c != "copy"], "copy"]
    assert {r.hash for r in out.collect()} == {"mine"} and out.count() == mixing.copied(frame(spark, rows)).count()


def test_copies_of_repeated_rows(spark):
    rng = __import__("random").Random(14)
    rows = [(k, prose(rng, 30), "en", f"s{k % 2}", 1) for k in range(40)]
    rows += [(7, rows[7][1], "en", "s1", 1)] * 5 + [(7, rows[7][1], "en", "s0", 1)] + [(None, None, None, None, 0)] * 2
    docs = frame(spark, rows)
    out = counted((r.doc_id, r.source) for r in mixing.copied(docs).collect())
    want = Counter()
    for r in mixing.mixed(docs).collect():
        want[repr((r.doc_id, r.source))] += r.copies
    assert out == +want and max(r.copy for r in mixing.copied(docs).collect()) <= mixing.MOST_COPIES


# Decontamination


@pytest.mark.parametrize("block_bytes", [8 << 20, 200])
def test_decontamination(spark, block_bytes):
    rows = awkward()
    passage = rows[-4][1].split()
    items = [(1, " ".join(passage[5:25]).upper()), (2, " ".join(passage[30:41]).replace(" ", " - ")), (3, "zu ZU zu"), (4, None), (5, ""), (6, "ü"), (6, "nowhere to be found at all in any of these texts"), (None, "null id"), (10, " ".join(passage[5:25]))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    windows = {}
    for k, t in items:
        w = word.findall(lower(t))
        n = min(10, len(w))
        for j in range(len(w) - n + 1 if w else 0):
            windows.setdefault(tuple(w[j : j + n]), set()).add("" if k is None else str(k))
    want = []
    for r in rows:
        w, hit, found = word.findall(lower(r[1])), set(), set()
        for n in {len(x) for x in windows}:
            for j in range(len(w) - n + 1):
                if ids := windows.get(tuple(w[j : j + n])):
                    hit |= set(range(j, j + n))
                    found |= ids
        want.append((r[0], len(w), len(hit), sorted(found)))
    out = decontamination.marked(frame(spark, rows, extra=True).drop("score"), bench, block_bytes=block_bytes)
    assert counted((r.doc_id, r.n_words, r.n_hit, r["items"]) for r in out.collect()) == counted(want)
    assert any(x[2] for x in want)
    empty = decontamination.marked(frame(spark, rows), bench.where("false"))
    assert empty.where("n_hit > 0").count() == 0 and empty.count() == len(rows)
    assert decontamination.marked(frame(spark, []), bench).count() == 0


# Exact substrings


def brute_removed(texts, length):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(b[k : k + length] for b in raw for k in range(len(b) - length + 1))
    out = []
    for b in raw:
        gone = bytearray(len(b))
        for k in range(len(b) - length + 1):
            if seen[b[k : k + length]] > 1:
                gone[k : k + length] = b"\1" * length
        runs = sum(1 for k in range(len(b)) if gone[k] and not (k and gone[k - 1]))
        out.append((len(b), sum(gone), runs, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest()))
    return out


@pytest.mark.parametrize("hot", [1 << 16, 1])
def test_suffixes(spark, monkeypatch, hot):
    monkeypatch.setattr(suffixes, "HOT", hot)
    rows = awkward()
    out = suffixes.deduplicated(frame(spark, rows, extra=True)).collect()
    want = [(r[0], *w) for r, w in zip(rows, brute_removed([r[1] for r in rows], 200), strict=True)]
    assert counted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in out) == counted(want)
    assert suffixes.deduplicated(frame(spark, [])).count() == 0


def test_suffixes_of_edited_copies(spark):
    import random

    rng = random.Random(5)
    base = bytes(rng.choice(b"abcd ") for _ in range(1500)).decode()
    texts = [base]
    for _ in range(25):
        t = list(base[rng.randrange(300) : 1500 - rng.randrange(300)])
        for _ in range(rng.randrange(5)):
            t[rng.randrange(len(t))] = "X"
        texts.append("".join(t))
    rows = [(k, t, None, None, None) for k, t in enumerate(texts)]
    want = [(k, *w) for k, w in enumerate(brute_removed(texts, 200))]
    for hot in (None, 4):
        out = suffixes.deduplicated(frame(spark, rows), hot=hot).collect()
        assert counted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in out) == counted(want)


def test_suffixes_of_one_gram_in_very_many_contexts(spark):
    """One string stands in 66,000 texts; of a few hundred the surroundings are shared too, to either side of the threshold."""
    rng = np.random.default_rng(3)
    gram = "".join(rng.choice(list("abcdefgh"), 90))
    letters = np.array(list("ijklmnopqrstuvwxyz"))
    texts = ["".join(a) + gram + "".join(b) for a, b in zip(rng.choice(letters, (66_000, 60)), rng.choice(letters, (66_000, 60)), strict=True)]
    for k in range(0, 900, 3):
        left, right = int(rng.integers(48, 61)), int(rng.integers(48, 61))
        texts[k + 1] = "".join(rng.choice(letters, 60 - left)) + texts[k][60 - left : 150 + right] + "".join(rng.choice(letters, 60 - right))
    rows = [(k, t, None, None, None) for k, t in enumerate(texts)]
    out = suffixes.deduplicated(frame(spark, rows)).select("doc_id", "n_removed", "n_spans").where("n_removed > 0").collect()
    windows = Counter(t[k : k + 200] for t in texts for k in range(11))
    want = []
    for n, t in enumerate(texts):
        at = [k for k in range(11) if windows[t[k : k + 200]] > 1]
        if at:
            want.append((n, at[-1] + 200 - at[0], 1))
    assert sorted(map(tuple, out)) == want and len(want) > 100


def test_suffixes_of_a_long_text(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "PIECE", 1000)
    monkeypatch.setattr("glyphmill.llm.common.SLICE_BYTES", 1000)
    rows = awkward()
    raw = np.frombuffer(rows[74][1].encode(), np.uint8)
    whole = list(zip(*suffixes.contexts(raw, np.array([0, len(raw)]), 200), strict=True))
    covered = lambda found: {(int(g), int(a) - k) for _, g, _, a, b, f in found for k in range(int(b) - (int(b) + int(f) - 200), int(b) + 1)}
    parts = []
    for at in range(0, len(raw), 1000):
        cut = raw[at : at + 1000 + 199]
        parts += [(t, g, c, a + at, b, f) for t, g, c, a, b, f in zip(*suffixes.contexts(cut, np.array([0, len(cut)]), 200), strict=True)]
    assert covered(parts) == covered(whole)


# Paragraphs


def test_paragraphs(spark):
    rows = awkward()
    rng = __import__("random").Random(11)
    from helpers import prose

    line = prose(rng, 60).split()
    edited = [*line[:30], "other", *line[31:]]
    far = [w if k % 3 else "q" for k, w in enumerate(line)]
    rows += [(200, "first\n" + " ".join(line) + "\nend", "en", "a", 1), (201, " ".join(edited) + "\n" + prose(rng, 30), "en", "a", 1), (202, " ".join(far), "en", "a", 1), (203, "start\n" + " ".join(line).upper(), "en", "a", 1)]
    out = {r.doc_id: r for r in paragraphs.deduplicated(frame(spark, rows, extra=True)).collect()}
    texts = {r[0]: (r[1] or "").encode() for r in rows}
    assert out[200].n_removed == 0 and out[200].n_shared > 0 and out[200].class_ids == [200]
    for k, want in ((201, " ".join(edited)), (203, " ".join(line).upper())):
        assert out[k].class_ids == [200] and [texts[k][s.start : s.end].decode() for s in out[k].spans] == [want]
    assert out[202].n_removed == 0
    assert out[61].n_removed == len(texts[61]) and out[60].n_removed == 0  # an exact copy
    assert 63 in out[64].class_ids and 63 in out[75].class_ids and out[64].n_removed > 0  # a passage inside other text
    for k in range(60):
        assert out[k].n_removed == 0, k
    assert out[65].n_bytes == 0 and out[65].n_shared == 0
    assert paragraphs.deduplicated(frame(spark, [])).count() == 0
    assert paragraphs.bands_for(0.8, 0.985, 3) == 6


def test_passages_are_removed_whole(spark):
    rng = __import__("random").Random(12)
    unlike = lambda n: [f"w{rng.random()}" for _ in range(n)]
    rows, want = [], {}
    for k in range(40):  # of 20 words and more, in one line and wrapped, inside unlike text
        passage = unlike(20 + k)
        a, b = unlike(30 + k % 13), unlike(11 + k % 17)
        rows += [(2 * k, " ".join(a + passage + unlike(40)), "en", "a", 1), (2 * k + 1, " ".join(b) + "\n" + "\n".join(passage) + "\n" + " ".join(unlike(9)), "en", "a", 1)]
        want |= {2 * k: [], 2 * k + 1: ["\n".join(passage)]}
    rows.append((100, "zu " * 399 + "zu", "en", "a", 1))
    out = {r.doc_id: r for r in paragraphs.deduplicated(frame(spark, rows)).collect()}
    texts = {r[0]: r[1] for r in rows}
    assert {k: [texts[k][s.start : s.end] for s in out[k].spans or []] for k in want} == want
    left = texts[100]
    for s in reversed(out[100].spans):
        left = left[: s.start] + left[s.end :]
    assert len(left.split()) == 8  # the first place stays


def test_recall_of_paragraphs(spark):
    """Edited lines among unlike ones, against all pairs of lines: at least 0.95 of those of similarity 0.8 are removed but for one."""
    rng = __import__("random").Random(21)
    unlike = lambda n: [f"w{rng.randrange(3000)}" for _ in range(n)]
    rows, lines = [], []
    for k in range(60):
        base = unlike(rng.randint(40, 120))
        for _ in range(3):
            edited = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 50))):
                edited[rng.randrange(len(edited))] = f"x{rng.random()}"
            lines.append((f"d{len(rows):04d}", " ".join(edited)))
            rows.append((lines[-1][0], " ".join(unlike(25)) + "\n" + lines[-1][1] + "\n" + " ".join(unlike(30))))
    docs = spark.createDataFrame(rows, "doc_id string, text string").repartition(3)
    sets = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in (t.split() for _, t in lines)]
    group = list(range(len(sets)))
    for a, b in [(a, b) for b in range(len(sets)) for a in range(b) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]:
        group = [group[a] if g == group[b] else g for g in group]
    want = {k for k in range(len(sets)) if group.index(group[k]) < k}
    out = {r.doc_id: r for r in paragraphs.deduplicated(docs).collect()}
    text = dict(rows)
    gone = {k for k, (d, t) in enumerate(lines) if any(text[d][s.start : s.end] == t for s in out[d].spans or [])}
    assert len(gone & want) >= 0.95 * len(want) and len(want) > 60
    assert gone <= want
    for k, t in rows:  # the unlike lines stay
        left = t
        for s in reversed(out[k].spans or []):
            left = left[: s.start] + left[s.end :]
        assert t.split("\n")[0] in left and t.split("\n")[2] in left


def test_runs_stop_where_texts_differ(spark):
    """Shared runs with an unlike word here and there, each in two documents, are removed up to it."""
    rng = __import__("random").Random(22)
    unlike = lambda n: [f"w{rng.random()}" for _ in range(n)]
    rows, want = [], {}
    for k in range(40):
        parts = [unlike(rng.randint(20, 45)) for _ in range(3)]
        one = sum(([f"a{k}{j}", *p] for j, p in enumerate(parts)), unlike(20))
        two = sum(([f"b{k}{j}", *p] for j, p in enumerate(parts)), unlike(12)) + unlike(3)
        rows += [(2 * k, " ".join(one), "en", "a", 1), (2 * k + 1, " ".join(two), "en", "a", 1)]
        want |= {2 * k: [], 2 * k + 1: [" ".join(p) for p in parts]}
    out = {r.doc_id: r for r in paragraphs.deduplicated(frame(spark, rows)).collect()}
    texts = {r[0]: r[1] for r in rows}
    assert {k: [texts[k][s.start : s.end] for s in out[k].spans or []] for k in want} == want
    assert all(out[k].n_shared == 3 for k in want)


def test_short_lines_take_part(spark):
    rng = __import__("random").Random(13)
    unlike = lambda n: [f"w{rng.random()}" for _ in range(n)]
    verse = "\n".join(" ".join(unlike(3)) for _ in range(5))
    both = " ".join(unlike(12)) + "\n" + verse + "\n" + " ".join(unlike(12))
    texts = ["a short text", "A short  text", verse, verse + "\n" + " ".join(unlike(30)), both, "short", "Short", both, " \t", " \t"]
    out = {r.doc_id: r for r in paragraphs.deduplicated(frame(spark, [(k, t, "en", "a", 1) for k, t in enumerate(texts)])).collect()}
    removed = {k: [texts[k][s.start : s.end] for s in out[k].spans or []] for k in out}
    assert removed == {0: [], 1: [texts[1]], 2: [], 3: [verse], 4: [verse], 5: [], 6: ["Short"], 7: [both], 8: [], 9: []}
    assert out[7].class_ids[0] == 2 and out[8].n_shared == 0
    assert paragraphs.paragraph_starts([3, 3, 3, 2, 10, 2, 9, 3, 5, 1], [0] * 7 + [1] * 3, 8) == [0, 4, 5, 6, 7]


def test_words():
    raw = words.LOWER[np.frombuffer("Ab c\tdé ab".encode() + b"ab x", np.uint8)]
    w = words.Words(raw, np.array([0, 11, 15]), words.SOLID)
    assert [raw[a:b].tobytes().decode() for a, b in zip(w.start, w.end, strict=True)] == ["ab", "c", "dé", "ab", "ab", "x"]
    assert w.hash[0] == w.hash[3] == w.hash[4] and w.text.tolist() == [0, 0, 0, 0, 1, 1]
    assert len(w.shingles(2)[0]) == 4


def test_schema_is_kept(spark):
    docs = frame(spark)
    assert docs.schema.simpleString().count("string") == SCHEMA.count("string")
    assert docs.where(F.col("text").isNull()).count() == 2


def test_stretches_of_seeds():
    """Against a plain pass over each text's seeds, with repeated ones, chains that go on and texts without any; memory doesn't follow the batch."""
    rng, width, rows = random.Random(12), 8, []
    for key in range(5000):
        firsts = sorted(rng.sample(range(400), rng.randrange(0, 20)))
        held = [(f, (n if rng.random() < 0.9 else 0), rng.randrange(2), rng.randrange(5), 9, rng.randrange(50), rng.randrange(2)) for f, n in zip(firsts, [*firsts[1:], 0], strict=False)]
        held += held[: rng.randrange(2)]
        rng.shuffle(held)
        rows.append((key, 7, held))
    ints, longs = pa.int32(), pa.int64()
    names = {"first": ints, "next": ints, "link": longs, "key": longs, "m": ints, "to": ints, "own": longs}
    seeds = pa.array([[dict(zip(names, h, strict=True)) for h in r[2]] for r in rows], pa.list_(pa.struct(list(names.items()))))
    batch = pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], longs), pa.array([r[1] for r in rows], ints), seeds], names=["key", "n", "seeds"])
    tracemalloc.start()
    found = list(paragraphs.covered(iter([batch]), width))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    want = []
    for key, n, held in rows:
        open_ = []
        for first, after, link, k, m, to, own in sorted(held):
            end = max(first + width, after if after and link == own and any(h[0] == after for h in held) else 0)
            if open_ and first <= open_[-1][1]:
                open_[-1][1], open_[-1][3] = max(open_[-1][1], end), (first, k, m, to)
            else:
                open_.append([first, end, (first, k, m, to), (first, k, m, to)])
        want += [(key, n, o[0], o[3][0] + width, *o[2][1:], *o[3][1:3], o[3][3] + width) for o in open_]
    assert sorted(tuple(r.values()) for b in found for r in b.to_pylist()) == sorted(want) and len(want) > 5000
    assert peak < 8 << 20


def test_a_block_of_near_fingerprints_needs_little_memory():
    """All pairs of a large block are looked at, a bounded number at a time."""
    rng, n = np.random.default_rng(1), 4096
    flips = (np.uint64(1) << rng.integers(0, 64, (3, 4 * n)).astype(np.uint64))
    fp = np.unique(np.uint64(0x123456789ABCDEF) ^ np.bitwise_xor.reduce(flips))[:n].view(np.int64)
    bits = fp.view(np.uint64)
    rows, links = [np.zeros(n, np.int64), np.zeros(n, np.int64), np.full(n, 2, np.int8), fp], simhash.Links()
    tracemalloc.start()
    simhash.linked(rows[0], rows, lambda r, a, b: np.bitwise_count(bits[a] ^ bits[b]) <= 3, simhash.PAIRS, links)
    u, v = links.cut()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    near = np.bitwise_count(bits[:, None] ^ bits[None, :]) <= 3
    a, b = (fp[k] for k in np.nonzero(np.triu(near, 1)))
    want = simhash.forest(a, b)
    assert len(fp) == n and np.array_equal(u, want[0]) and np.array_equal(v, want[1])
    assert peak < 48 << 20
