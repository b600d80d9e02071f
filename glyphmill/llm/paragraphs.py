"""Substring dedup by paragraph MinHash banding.

Paragraphs are a text's lines of at least `least_words` words, and shorter lines joined until they hold as many (a text with
fewer is one paragraph), as sets of word shingles; of fewer words than a shingle, all are one. Each gives `bands` keys of `rows`
min-hashes, tuned so that a pair of the wanted similarity shares a key with the wanted recall. Paragraphs that share a key
are brought together, their exact Jaccard similarity is computed, and verified links are joined to components. Passages
inside unlike paragraphs are found by seeds, whatever lines they are on: of each 2 * reach + 1 runs of `least_words` words
in a row the one of least hash, which a passage carries along wherever it is put in. Each seed is held against its first
place in the corpus: what lies between it and the next seed by one hash, and at the ends of what is covered so the words
around it one by one, to both sides. So of a passage of least_words + 2 * reach words or more all is found, however it is
wrapped; shorter runs inside other text stay.

Of each component, run and whole text the first place, by doc_id and position, stays; all others are removed. Equal paragraphs
are one node throughout; band keys that very many paragraphs share are verified as a grid of blocks. Only texts that hold a
paragraph to be verified or an end of a run are moved, compressed.

A null or empty text has no paragraph. A null doc_id sorts first. Rows that repeat a doc_id and text are one place, so
that they get the same result. A very long text is one row in one task, with about twenty times its bytes in arrays. Empty
tables give no rows; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import dropped, joined, kept_columns, sieve, slices, table, utf8, written
from .graph import components
from .simhash import dealt, verified
from .suffixes import least, packed
from .words import BACK, BASE, LOWER, SOLID, Words, mixed, powers

SHINGLE, SIMILARITY, RECALL, ROWS, LEAST_WORDS, REACH = 5, 0.8, 0.985, 3, 8, 6
BLOCK_ROWS = 512
#: Texts whose seeds or words a task holds as arrays at a time.
TEXTS = 512


def bands_for(similarity: float, recall: float, rows: int) -> int:
    """The fewest bands that find a pair of this similarity with this probability."""
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - similarity**rows)))


def paragraph_starts(count: list[int], text: list[int], least_words: int) -> list[int]:
    """The lines at which paragraphs begin, given each line's words and text.

    A line of so many words is a paragraph; shorter ones that follow one another are joined until they hold as many, and
    what is left of them joins the short lines before it, if there are any.
    """
    starts, held, of, short, before = [], 0, -1, False, False
    for k, (n, t) in enumerate(zip(count, text, strict=True)):
        same = t == of
        if same and short and held < least_words and n < least_words:
            held += n
            continue
        if short and before and held < least_words:
            starts.pop()
        before = same and short
        starts.append(k)
        held, of, short = n, t, n < least_words
    if short and before and held < least_words:
        starts.pop()
    return starts


class Lines:
    """The paragraphs of some texts, with their words: lines, the short ones joined."""

    def __init__(self, raw: np.ndarray, off: np.ndarray, least_words: int = 1):
        cuts = np.unique(np.concatenate([off, np.flatnonzero(raw == 10) + 1]))
        self.off = off
        self.words = w = Words(LOWER[raw], cuts, SOLID)
        self.text = np.searchsorted(off, cuts[:-1], "right") - 1
        starts = np.array(paragraph_starts(np.diff(w.first).tolist(), self.text.tolist(), least_words), np.int64)
        self.text = self.text[starts]
        w.off, w.first = np.append(cuts[starts], cuts[-1]), np.append(w.first[starts], w.first[-1])
        w.text = np.repeat(np.arange(len(starts)), np.diff(w.first))
        total = np.zeros(len(self.words) + 1, np.uint64)
        np.cumsum(self.words.hash * powers(len(self.words), BASE), out=total[1:])
        self.total, self.back = total, powers(len(self.words) + 1, BACK)

    def hash(self, first: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hash of the words first, first + 1, ... end - 1, for each."""
        return mixed((self.total[end] - self.total[first]) * self.back[first] + (end - first).astype(np.uint64))

    def span(self, line: np.ndarray, first: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes, from the start of the text, of some words of a line."""
        base = self.off[self.text[line]]
        return self.words.start[first] - base, self.words.end[end - 1] - base

    def paragraphs(self, least_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Paragraph, first word and end of each of so many words, or of all words of its text."""
        first, end = self.words.first[:-1], self.words.first[1:]
        whole = np.bincount(self.text, end - first, len(self.off))[self.text]
        line = np.flatnonzero((end - first >= least_words) | (end > first) & (end - first == whole))
        return line, first[line], end[line]

    def shingles(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash of each n words that follow one another in a paragraph, or of all its words if it has fewer, and the paragraph."""
        h, at = self.words.shingles(n)
        of, size = self.words.text[at], np.diff(self.words.first)
        few = np.flatnonzero((size > 0) & (size < n))
        if len(few):
            first = self.words.first[few]
            h, of = np.concatenate([h, self.hash(first, first + size[few])]), np.concatenate([of, few])
            order = np.argsort(of, kind="stable")
            h, of = h[order], of[order]
        return h, of

    def seeds(self, width: int, window: int) -> np.ndarray:
        """First words of the runs of `width` words whose hash is least among `window` such runs in a row of one text."""
        text = self.text[self.words.text]
        run = np.flatnonzero(text[: max(0, len(text) - width + 1)] == text[width - 1 :])
        if not len(run):
            return run
        mask, at = np.uint64((1 << 22) - 1), np.arange(len(run))
        place = self.hash(run, run + width) & ~mask | (at.astype(np.uint64) & mask)
        of = text[run]
        low, base = least(place, window), at[: max(0, len(run) - window + 1)]
        full = of[base] == of[base + window - 1]
        begins = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
        small = np.diff(np.append(begins, len(run))) < window  # texts with fewer runs: the least of all
        low = np.concatenate([low[full], np.minimum.reduceat(place, begins)[small]])
        base = np.concatenate([base[full], begins[small]])
        return run[np.unique(base + ((low & mask).astype(np.int64) - base & int(mask)))]


def min_hash_keys(lines: Lines, line: np.ndarray, bands: int, rows: int, shingle: int) -> np.ndarray:
    """bands keys for each of these lines."""
    h, of = lines.shingles(shingle)
    first = np.searchsorted(of, line)
    last = np.searchsorted(of, line, "right")
    out = np.zeros((len(line), bands), np.uint64)
    if not len(line):
        return out
    edges = np.stack([first, last], axis=1).reshape(-1)
    edges = edges[:-1] if edges[-1] == len(h) else edges
    factors = mixed(np.arange(1, bands * rows + 1, dtype=np.uint64)) | np.uint64(1)
    for k in range(bands * rows):
        out[:, k // rows] = mixed(out[:, k // rows] * BASE + np.minimum.reduceat(h * factors[k], edges)[::2])
    return out


def row_text(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return kept_columns(docs, ["doc_id", "text"]).select("doc_id", text.alias("text"), F.xxhash64(text).alias("key"), F.octet_length(text).alias("n"))


def fresh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches (key, n, text) in slices, with each text once a task."""
    seen = set()
    for batch in batches:
        rows = [k for k, x in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)) if not (x in seen or seen.add(x))]
        yield from slices(batch.take(pa.array(rows, pa.int64())))


def listed(docs: DataFrame, bands: int, rows: int, shingle: int, least_words: int) -> DataFrame:
    """unit (hash of its words), key, n, at (its number), start, end and keys of each paragraph."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in fresh(batches):
            lines = Lines(*joined(utf8(part.column(2))), max(least_words, shingle))
            line, first, end = lines.paragraphs(max(least_words, shingle))
            text = lines.text[line]
            start, stop = lines.span(line, first, end)
            keys = min_hash_keys(lines, line, bands, rows, shingle)
            place = pa.array(text)
            array = pa.ListArray.from_arrays(pa.array(np.arange(len(line) + 1, dtype=np.int32) * bands), pa.array(keys.view(np.int64).reshape(-1)))
            at = line - np.searchsorted(lines.text, text)
            columns = [pa.array(lines.hash(first, end).view(np.int64)), part.column(0).take(place), part.column(1).take(place), *(pa.array(x.astype(np.int32)) for x in (at, start, stop)), array]
            yield pa.RecordBatch.from_arrays(columns, names=["unit", "key", "n", "at", "start", "end", "keys"])

    return docs.select("key", "n", "text").mapInArrow(make, "unit long, key long, n int, at int, start int, end int, keys array<long>")


def seeded(docs: DataFrame, width: int, window: int) -> DataFrame:
    """unit, key, n, first (word), next (the next seed's first word, 0 for the last) and link (hash of the words from first to the
    next one's end) of each seed."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in fresh(batches):
            lines = Lines(*joined(utf8(part.column(2))))
            first = lines.seeds(width, window)
            text = lines.text[lines.words.text[first]]
            base = np.searchsorted(lines.words.start, lines.off)[text]
            link, after = np.zeros(len(first), np.uint64), np.zeros(len(first), np.int64)
            more = np.flatnonzero(text[1:] == text[:-1])
            link[more], after[more] = lines.hash(first[more], first[more + 1] + width), (first - base)[more + 1]
            columns = [pa.array(lines.hash(first, first + width).view(np.int64)), *(part.column(k).take(pa.array(text)) for k in (0, 1)), pa.array((first - base).astype(np.int32)), pa.array(after.astype(np.int32)), pa.array(link.view(np.int64))]
            yield pa.RecordBatch.from_arrays(columns, names=["unit", "key", "n", "first", "next", "link"])

    return docs.select("key", "n", "text").mapInArrow(make, "unit long, key long, n int, first int, next int, link long")


def covered(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """stretches() of Arrow batches (key, n, seeds), as arrays of a few texts at a time."""
    for batch in (b.slice(k, TEXTS) for b in batches for k in range(0, b.num_rows, TEXTS)):
        seeds = batch.column(2)
        text = np.repeat(np.arange(len(seeds)), np.diff(seeds.offsets.to_numpy()))
        x = {f.name: c.to_numpy(zero_copy_only=False) for f, c in zip(seeds.type.value_type, seeds.flatten().flatten(), strict=True)}
        order = np.lexsort((x["first"], text))
        text, x = text[order], {k: v[order] for k, v in x.items()}
        if not len(text):
            continue
        first, after = x["first"].astype(np.int64), x["next"].astype(np.int64)
        end = first + width
        follows = np.flatnonzero((text[1:] == text[:-1]) & (first[1:] == after[:-1]) & (after[:-1] > 0) & (x["link"] == x["own"])[:-1])
        end[follows] = np.maximum(end, after)[follows]  # that seed goes on from there
        base = text.astype(np.int64) << 32  # so that no text reaches into the next
        begins = np.concatenate([[True], (base + first)[1:] > np.maximum.accumulate(base + end)[:-1]])
        a = np.flatnonzero(begins)
        b = np.append(a[1:], len(text)) - 1
        of = pa.array(text[a])
        ints = (first[a], first[b] + width, x["key"][a], x["m"][a], x["to"][a], x["key"][b], x["m"][b], x["to"][b] + width)
        columns = [pa.array(v, pa.int64() if k in (2, 5) else pa.int32()) for k, v in enumerate(ints)]
        yield pa.RecordBatch.from_arrays([batch.column(0).take(of), batch.column(1).take(of), *columns], names=["key", "n", "first", "end", "lkey", "ln", "lat", "rkey", "rn", "rat"])


def stretches(seeds: DataFrame, width: int) -> DataFrame:
    """The stretches of words of each text that its seeds in `seeds` cover, with the places that they begin and end like.

    seeds (key, n, seeds): of each text its seeds that have a first place elsewhere: first, next, link, and that place's key, n
    (as m), first (as to) and link (as own). A seed whose link is its first place's covers the words up to the next one too.
    """

    kinds = "key long, n int, first int, end int, lkey long, ln int, lat int, rkey long, rn int, rat int"
    return seeds.select("key", "n", "seeds").mapInArrow(lambda batches: covered(batches, width), kinds)


def neighbours(texts: DataFrame, reach: int) -> DataFrame:
    """For the places in `need` (at, right) of each text the hashes of up to `reach` words before or from there, outward, and the
    bytes at which a stretch begins or ends that is longer by none, one, ... of them."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for batch in (b.slice(k, TEXTS) for b in batches for k in range(0, b.num_rows, TEXTS)):
            out = []
            for key, n, z, need in zip(*(batch.column(k) for k in range(4)), strict=True):
                text = np.frombuffer(unpack.decompress(z.as_py()), np.uint8)
                w = Lines(text, np.array([0, len(text)])).words
                for x in need.as_py():
                    at = x["at"]
                    if x["right"]:
                        hashes, edges = w.hash[at : at + reach], w.end[at - 1 : at + reach]
                    else:
                        hashes, edges = w.hash[max(0, at - reach) : at][::-1], w.start[max(0, at - reach) : at + 1][::-1]
                    out.append((key.as_py(), n.as_py(), at, x["right"], hashes.view(np.int64).tolist(), edges.tolist()))
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.list_(pa.int64()), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], names=["key", "n", "at", "right", "hashes", "edges"])

    return texts.select("key", "n", "z", "need").mapInArrow(make, "key long, n int, at int, right boolean, hashes array<long>, edges array<int>")


def runs(docs: DataFrame, texts: DataFrame, width: int, window: int, least_run: int) -> DataFrame:
    """key, n, start, end (bytes), doc and the place (mkey, mn, mat) that it repeats of each run of at least `least_run` words that is elsewhere first.

    Two places that share width + window - 1 words share a seed among them, and so do each window - 1 words more that they
    share; from the last seed of a shared run fewer than `window` words are left, which are held against those around the
    first place of that seed. texts: key, n and doc, the least doc_id that has the text.
    """
    seeds = written(seeded(docs, width, window), "seeds")
    place = F.xxhash64("key", "n", "first")  # one number, as these are the most rows of all
    again = written(seeds.groupBy("unit").agg(F.min(place).alias("low"), F.max(place).alias("high")).where("low < high").select("unit"), "seeds-again")
    shared = written(seeds.where(sieve(again, "unit")("unit")).join(again, "unit").join(texts, ["key", "n"]), "seeds-shared")
    dropped(seeds)
    dropped(again)
    order = F.struct(F.col("doc").isNotNull().alias("known"), "doc", "key", "n", "first", "link")
    firsts = written(shared.groupBy("unit").agg(F.min(order).alias("f")), "seeds-first")
    inside = (F.col("key") == F.col("f.key")) & (F.col("n") == F.col("f.n")) & (F.col("first") < F.col("f.first") + width)
    later = shared.join(firsts, "unit").where(~inside)
    each = F.struct("first", "next", "link", F.col("f.key").alias("key"), F.col("f.n").alias("m"), F.col("f.first").alias("to"), F.col("f.link").alias("own"))
    found = written(stretches(later.groupBy("key", "n").agg(F.collect_list(each).alias("seeds")), width), "stretches")  # of one text, so bounded by its length
    dropped(shared)
    dropped(firsts)
    at = lambda key, n, at, right: F.struct(F.col(key).alias("key"), F.col(n).alias("n"), F.col(at).alias("at"), F.lit(right).alias("right"))
    places = F.array(at("key", "n", "first", False), at("lkey", "ln", "lat", False), at("key", "n", "end", True), at("rkey", "rn", "rat", True))
    need = found.select(F.explode(places).alias("p")).groupBy("p.key", "p.n").agg(F.collect_set(F.struct("p.at", "p.right")).alias("need"))
    around = packed(docs).join(written(need, "ends"), ["key", "n"]).dropDuplicates(["key", "n"])
    around = written(neighbours(around, window - 1), "neighbours")
    side = lambda right, names, more: around.where(F.col("right") == F.lit(right)).select(F.col("key").alias(names[0]), F.col("n").alias(names[1]), F.col("at").alias(names[2]), *more)
    own = lambda c: [F.col("hashes").alias(f"{c}own"), F.col("edges").alias(f"{c}edges")]
    out = found.join(side(False, ("key", "n", "first"), own("l")), ["key", "n", "first"]).join(side(True, ("key", "n", "end"), own("r")), ["key", "n", "end"])
    out = out.join(side(False, ("lkey", "ln", "lat"), [F.col("hashes").alias("lfirst")]), ["lkey", "ln", "lat"]).join(side(True, ("rkey", "rn", "rat"), [F.col("hashes").alias("rfirst")]), ["rkey", "rn", "rat"])
    same = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.eqNullSafe(y) & x.isNotNull()), F.struct(F.lit(0).alias("k"), F.lit(True).alias("on")), lambda s, x: F.struct((s["k"] + (s["on"] & x).cast("int")).alias("k"), (s["on"] & x).alias("on")))["k"]
    out = out.withColumn("before", same("lown", "lfirst")).withColumn("after", same("rown", "rfirst")).where(F.col("end") - F.col("first") + F.col("before") + F.col("after") >= least_run)
    out = out.select("key", "n", F.element_at("ledges", F.col("before") + 1).alias("start"), F.element_at("redges", F.col("after") + 1).alias("end"), F.col("lkey").alias("mkey"), F.col("ln").alias("mn"), F.col("lat").alias("mat"))
    first = texts.select(F.col("key").alias("mkey"), F.col("n").alias("mn"), "doc")
    out = written(out.join(first, ["mkey", "mn"]), "runs")
    for x in (found, around):
        dropped(x)
    return out


def shingle_sets(texts: DataFrame, shingle: int, least_words: int) -> DataFrame:
    """fp (a paragraph's unit) and sets (its shingle hashes, sorted, eight bytes each) for the paragraphs in `need` of each text."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for batch in (b.slice(k, TEXTS) for b in batches for k in range(0, b.num_rows, TEXTS)):
            units, sets = [], []
            for z, need in zip(batch.column(0), batch.column(1), strict=True):
                text = np.frombuffer(unpack.decompress(z.as_py()), np.uint8)
                lines = Lines(text, np.array([0, len(text)]), max(least_words, shingle))
                h, of = lines.shingles(shingle)
                for x in need.as_py():
                    units.append(x["unit"])
                    sets.append(np.unique(h[np.searchsorted(of, x["at"]) : np.searchsorted(of, x["at"], "right")]).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(units, pa.int64()), pa.array(sets, pa.binary())], names=["fp", "sets"])

    return texts.select("z", "need").mapInArrow(make, "fp long, sets binary")


def linked_units(docs: DataFrame, units: DataFrame, shingle: int, similarity: float, least_words: int) -> DataFrame:
    """node and root of the paragraphs that have near-duplicates of other words: those that share a band key are verified."""
    keys = units.select("unit", F.posexplode("keys").alias("band", "value")).select("unit", F.xxhash64("band", "value").alias("key"))
    shared = written(keys.groupBy("key").agg(F.min("unit").alias("low"), F.max("unit").alias("high")).where("low < high").select("key"), "bands")
    meet = written(keys.where(sieve(shared, "key")("key")).join(shared, "key").distinct(), "meet")
    places = units.join(meet.select("unit").distinct(), "unit", "left_semi").groupBy("unit").agg(F.min(F.struct("key", "n", "at")).alias("one"))
    need = places.groupBy("one.key", "one.n").agg(F.collect_list(F.struct("unit", "one.at")).alias("need"))
    sets = shingle_sets(packed(docs).join(written(need, "need"), ["key", "n"]), shingle, least_words).dropDuplicates(["fp"])
    rows = dealt(meet.withColumnRenamed("unit", "fp"), False, BLOCK_ROWS).join(written(sets, "sets"), "fp").repartition("block")
    out = components(verified(rows, similarity))
    for x in (shared, meet):
        dropped(x)
    return out


def removals(places: DataFrame, group: Column, texts: DataFrame) -> DataFrame:
    """places that share `group` with another: key, n, start, end, gone, and the first place's text (mkey, mn), start (mat) and doc.

    The first place stays, and so do those that overlap it.
    """
    place = F.xxhash64("key", "n", "start", "end")
    rows = places.withColumn("group", group)
    again = rows.groupBy("group").agg(F.min(place).alias("low"), F.max(place).alias("high")).where("low < high").select("group")
    again = written(again, "groups")
    rows = written(rows.where(sieve(again, "group")("group")).join(again, "group").join(texts, ["key", "n"]).select("group", "doc", "key", "n", "start", "end"), "repeats")
    firsts = rows.groupBy("group").agg(F.min(F.struct(F.col("doc").isNotNull().alias("known"), "doc", "start", "key", "n", "end")).alias("f"))
    within = (F.col("key") == F.col("f.key")) & (F.col("n") == F.col("f.n")) & (F.col("start") < F.col("f.end"))
    return rows.join(written(firsts, "firsts"), "group").select("key", "n", "start", "end", F.col("f.key").alias("mkey"), F.col("f.n").alias("mn"), F.col("f.start").alias("mat"), F.col("f.doc").alias("doc"), (~within).alias("gone"))


def deduplicated(docs: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY, recall: float = RECALL, rows: int = ROWS, least_words: int = LEAST_WORDS, reach: int = REACH) -> DataFrame:
    """doc_id, n_bytes, n_shared, n_removed, n_spans, spans (start, end in bytes, removed) and class_ids of each document.

    n_shared counts its paragraphs and runs that are elsewhere too, and itself if it has copies; class_ids are the doc_ids
    that hold their first places, so documents that share a passage share a class. Runs have least_words + 2 * reach words at least.
    """
    own = row_text(docs)
    once = own.where(F.col("n") > 0)
    known = F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id")
    texts = once.groupBy("key", "n").agg(F.min(known).alias("low"), F.max(known).alias("high"), F.max(F.col("text").rlike(r"[^\x20\x09-\x0D]")).alias("some"))
    texts = written(texts.select("key", "n", F.col("low.doc_id").alias("doc"), ((F.col("low") < F.col("high")) & F.col("some")).alias("copied")), "texts")
    of = texts.select("key", "n", "doc")
    units = written(listed(once, bands_for(similarity, recall, rows), rows, shingle, least_words), "paragraphs")
    roots = written(linked_units(once, units, shingle, similarity, least_words), "components")
    places = units.drop("keys", "at").distinct().join(roots, F.col("unit") == F.col("node"), "left")
    found = written(removals(places, F.coalesce("root", "unit"), of), "paragraphs-shared")
    dropped(units)
    later = found.where("gone").drop("gone").unionByName(runs(once, of, least_words, 2 * reach + 1, least_words + 2 * reach)).withColumn("gone", F.lit(True))
    # at the first place of a paragraph or run its document shares it too, as do places that overlap it
    near = found.where("not gone").select("key", "n", F.col("start").alias("mat"), "doc")
    first = later.select(F.col("mkey").alias("key"), F.col("mn").alias("n"), "mat", "doc").unionByName(near).distinct()
    span = F.struct("start", "end")
    both = later.select("key", "n", span.alias("span"), "doc").unionByName(first.select("key", "n", F.lit(None).cast("struct<start int, end int>").alias("span"), "doc"))
    by_text = both.groupBy("key", "n").agg(F.count(F.lit(1)).alias("n_shared"), F.array_sort(F.collect_set("span")).alias("found"), F.array_sort(F.collect_set("doc")).alias("classes"))
    merged = F.aggregate("found", F.expr("cast(array() as array<struct<start int, end int>>)"), lambda out, x: F.when(
        (F.size(out) > 0) & (x["start"] <= F.element_at(out, -1)["end"]),
        F.concat(F.slice(out, 1, F.size(out) - 1), F.array(F.struct(F.element_at(out, -1)["start"].alias("start"), F.greatest(F.element_at(out, -1)["end"], x["end"]).alias("end")))),
    ).otherwise(F.concat(out, F.array(x))))
    done = by_text.withColumn("parts", merged).drop("found")
    done = written(texts.join(done, ["key", "n"], "left").where("copied or n_shared is not null"), "spans")
    out = own.select("doc_id", "key", "n").join(done, ["key", "n"], "left")
    copy = F.coalesce(F.col("copied") & ~F.col("doc_id").eqNullSafe(F.col("doc")), F.lit(False))
    whole = F.array(F.struct(F.lit(0).alias("start"), F.col("n").alias("end")))
    out = out.withColumn("spans", F.when(copy, whole).otherwise(F.col("parts")))
    n_shared = F.coalesce("n_shared", F.lit(0).cast("long")) + F.coalesce(F.col("copied").cast("long"), F.lit(0).cast("long"))
    firsts = F.when(F.col("copied") & F.col("doc").isNotNull(), F.array("doc")).otherwise(F.expr(f"cast(array() as array<{dict(docs.dtypes)['doc_id']}>)"))
    class_ids = F.when(n_shared > 0, F.array_sort(F.array_union(F.coalesce("classes", firsts), firsts)))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"])
    return out.select("doc_id", F.col("n").cast("long").alias("n_bytes"), n_shared.alias("n_shared"), F.coalesce(removed, F.lit(0).cast("long")).alias("n_removed"), F.coalesce(F.size("spans"), F.lit(0)).cast("long").alias("n_spans"), "spans", class_ids.alias("class_ids"))


def op5_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicated(table(spark, sf_dir, "documents")).drop("spans")
