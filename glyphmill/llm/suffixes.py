"""Exact substring dedup by threshold-bounded interval expansion on a positional Burrows-Wheeler transform.

Every string of `length` bytes that starts in two places goes, wherever it starts. The text is cut so that all places of
one string meet: a window of `length` bytes is given to the least (by hash) of its grams of GRAM bytes, the leftmost if
tied, which is the same gram at the same offset in each copy of the window. Windows in a row with one gram are its
context, at most length + WINDOW bytes. Grams that occur once in the corpus are done with; equal contexts are counted
and enter twice at most.

The distinct contexts of a gram, and a second place of each that occurs more than once, are aligned at it. Ordered by what
follows, with the common prefixes of neighbours, they are column 0 of a Burrows-Wheeler transform; the byte before each
context's column is its transform. One step of backward extension, breadth-first over all intervals of all grams of a task,
is the stable reordering by that byte, which lengthens the common prefixes inside each new interval by one; intervals that
can't come to `length` any more are dropped, and expansion stops at the last column. What shares `length` bytes with a
neighbour in some column is a window that starts twice. Every removal comes from there.

Grams, hashes and spans are shuffled; texts are, compressed, only towards the grams' places, once for each task that has
a copy. A gram with more than HOT distinct contexts (tens of thousands of texts that differ right around one string) is
not expanded in one task: its columns are cut into bands, and the contexts of a band are dealt out by the bytes that all
the band's windows share, a longer gram; a band that is still hot is cut into single columns.

A null or empty text has no byte. Repeated rows are documents of their own, so a text of at least `length` bytes that is
there twice is removed from both. Empty tables give no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Sieve, dropped, joined, kept_columns, slices, table, utf8, written
from .words import BACK, BASE, mixed, powers

LENGTH, GRAM = 200, 32
PIECE, CHUNK, HOT = 1 << 20, 1 << 14, 1 << 15
#: Columns of a band, for grams of more than HOT contexts, and for bands that are still hot.
STEPS = (16, 1)
BYTES = "anchor long, ctx long, slot byte, before int, bytes binary"
BYTES_TYPES = (pa.int64(), pa.int64(), pa.int8(), pa.int32(), pa.binary())
ROW = "anchor long, ctx long, key long, n int, at int, before int, after int"
TYPES = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32())


def least(values: np.ndarray, window: int) -> np.ndarray:
    """The minimum of each `window` values in a row, from block-wise running minima."""
    n = len(values) - window + 1
    if n <= 0:
        return np.zeros(0, values.dtype)
    blocks = -(-len(values) // window)
    padded = np.full(blocks * window, np.iinfo(values.dtype).max, values.dtype)
    padded[: len(values)] = values
    padded = padded.reshape(blocks, window)
    ahead = np.minimum.accumulate(padded, axis=1).reshape(-1)
    behind = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(behind[:n], ahead[window - 1 : window - 1 + n])


class Sums:
    """Polynomial hashes of any stretch of some bytes."""

    def __init__(self, raw: np.ndarray):
        self.total = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * powers(len(raw), BASE), out=self.total[1:])
        self.back = powers(len(raw) + 1, BACK)

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.total[end] - self.total[start]) * self.back[start]


def contexts(raw: np.ndarray, off: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """text, gram hash, context hash, gram's place in the text, and bytes of the context before and from that place."""
    window, mask = length - GRAM + 1, np.uint64((1 << 22) - 1)
    starts = np.ones(max(0, len(raw) - length + 1), bool)
    for end in off[1:-1].tolist():  # windows lie in one text
        starts[max(0, end - length + 1) : end] = False
    sums = Sums(raw)
    first = np.arange(max(0, len(raw) - GRAM + 1))
    gram = mixed(sums(first, first + GRAM))
    place = (least(gram & ~mask | first.astype(np.uint64), window) & mask).astype(np.int64)
    at = np.flatnonzero(starts)
    m = place[at]
    new = np.flatnonzero(np.concatenate([[True], (m[1:] != m[:-1]) | (at[1:] != at[:-1] + 1)])) if len(at) else np.zeros(0, np.int64)
    low, high, m = at[new], at[np.concatenate([new[1:], [len(at)]]).astype(np.int64) - 1] if len(at) else at, m[new]
    text = np.searchsorted(off, low, "right") - 1
    whole = mixed(mixed(sums(low, high + length)) + (m - low).astype(np.uint64) * np.uint64(1 << 32) + (high - low).astype(np.uint64))
    return text, gram[m], whole, m - off[text], m - low, high + length - m


def pieces(part: pa.RecordBatch, column: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """First row, bytes of it passed over, and raw bytes with offsets, in pieces; a long text's pieces overlap by a window."""
    raw, off = joined(utf8(part.column(column)))
    if len(raw) <= 2 * PIECE:
        yield 0, 0, raw, off
        return
    for at in range(0, len(raw), PIECE):  # slices() leaves one text here
        yield 0, at, (cut := raw[at : at + PIECE + LENGTH - 1]), np.array([0, len(cut)])


def anchored(docs: DataFrame, length: int) -> DataFrame:
    """A row for each context of each text (key, n, text)."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                key, n = (part.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
                for row, passed, raw, off in pieces(part, 2):
                    text, gram, ctx, at, before, after = contexts(raw, off, length)
                    rows = (gram.view(np.int64), ctx.view(np.int64), key[row + text], n[row + text], at + passed, before, after)
                    yield pa.RecordBatch.from_arrays([pa.array(c).cast(t) for c, t in zip(rows, TYPES, strict=True)], names=[x.split()[0] for x in ROW.split(", ")])

    return docs.select("key", "n", "text").mapInArrow(make, ROW)


def packed(docs: DataFrame, among: Sieve | None = None) -> DataFrame:
    """key, n and z (the text, compressed), once for each task that has the text; only of keys that pass among, if given."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, pack = set(), zstandard.ZstdCompressor(3)
        for batch in batches:
            for part in slices(batch):
                rows = [k for k, x in enumerate(zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True)) if not (x in seen or seen.add(x))]
                if among is not None:
                    rows = np.array(rows, np.int64)[among.has(part.column(0).to_numpy(zero_copy_only=False)[rows])].tolist()
                few = part.take(pa.array(rows, pa.int64()))
                yield pa.RecordBatch.from_arrays([few.column(0), few.column(1), pa.array([pack.compress(x.as_py()) for x in utf8(few.column(2))], pa.binary())], names=["key", "n", "z"])

    return docs.select("key", "n", "text").mapInArrow(make, "key long, n int, z binary")


def cut(texts: DataFrame) -> DataFrame:
    """The contexts listed in `need` of each text, with the bytes of each."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            rows = []
            for z, need in zip(batch.column(0), batch.column(1), strict=True):
                text = unpack.decompress(z.as_py())
                rows += [(x["anchor"], x["ctx"], x["slot"], x["before"], text[x["at"] - x["before"] : x["at"] + x["after"]]) for x in need.as_py()]
            for k in range(0, len(rows), CHUNK):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[k : k + CHUNK], strict=True), BYTES_TYPES, strict=True)], names=["anchor", "ctx", "slot", "before", "bytes"])

    return texts.select("z", "need").mapInArrow(make, BYTES)


def expanded(group: np.ndarray, before: np.ndarray, texts: list[bytes], length: int, wide: int) -> tuple[np.ndarray, np.ndarray]:
    """For each context the first and last column whose window starts elsewhere in its group too; -1 if none.

    Column j holds the windows that start j bytes before the gram; columns 0 to `wide` are expanded.
    """
    size = np.array([len(t) for t in texts])
    after = np.minimum(size - before, length)
    raw, at = np.frombuffer(b"".join(texts), np.uint8), np.cumsum(size) - size
    raw = np.concatenate([raw, np.zeros(length, np.uint8)])
    gram = at + before
    left = raw[np.maximum(gram[:, None] - 1 - np.arange(wide), 0)]  # the transform of column j, before any reordering
    right = raw[gram[:, None] + np.arange(length)]
    right[np.arange(length) >= after[:, None]] = 0
    number = np.unique(group, return_inverse=True)[1].astype(">u4")
    keys = np.concatenate([number.view(np.uint8).reshape(-1, 4), right, after.astype(">u2").view(np.uint8).reshape(-1, 2)], axis=1)
    order = np.argsort(np.ascontiguousarray(keys).view(f"V{keys.shape[1]}").ravel(), kind="stable")
    number = number.astype(np.int64)
    differs = right[order[1:]] != right[order[:-1]]
    common = np.where(differs.any(1), differs.argmax(1), length)
    common = np.minimum(common, np.minimum(after[order[1:]], after[order[:-1]]))
    common[number[order[1:]] != number[order[:-1]]] = 0
    common = np.concatenate([[0], common, [0]])  # common[i]: of the i-th and the one before it
    low, high = np.full(len(texts), -1), np.full(len(texts), -1)
    for j in range(wide + 1):
        best = np.maximum(common[:-1], common[1:])
        found = order[best >= length]
        high[found] = j
        low[found[low[found] < 0]] = j
        # expand: intervals that the columns left can still bring to the threshold, in contexts that go on to the left
        keep = np.flatnonzero((before[order] > j) & (best + (wide - j) >= length))
        if len(keep) < 2 or j == wide:
            break
        byte = number[order[keep]] << 8 | left[order[keep], j]
        turn = np.argsort(byte, kind="stable")
        old, byte = keep[turn], byte[turn]
        same = np.flatnonzero(byte[1:] == byte[:-1])
        pairs = np.stack([old[same] + 1, old[same + 1] + 1], axis=1).reshape(-1)
        next_common = np.zeros(len(old) + 1, np.int64)
        if len(pairs):
            next_common[same + 1] = np.minimum.reduceat(common, pairs)[::2] + 1
        order, common = order[old], next_common
    return low, high


def repeated(rows: DataFrame, length: int, wide: int) -> DataFrame:
    """anchor, ctx, start and end: the span, relative to the gram, of a context's windows that start twice.

    rows: anchor, ctx, slot, before and bytes; a context that occurs twice has a row for either slot, so that both are expanded.
    """

    def flush(rows: list[np.ndarray | list]) -> pa.RecordBatch:
        anchor, ctx, slot, before, texts = rows
        new = (anchor[1:] != anchor[:-1]) | (ctx[1:] != ctx[:-1]) | (slot[1:] != slot[:-1])
        one = np.flatnonzero(np.concatenate([[True], new])) if len(anchor) else np.zeros(0, np.int64)
        anchor, ctx, before, texts = anchor[one], ctx[one], before[one], [texts[k] for k in one]
        low, high = expanded(anchor, before.astype(np.int64), texts, length, wide) if len(one) > 1 else (np.full(len(one), -1),) * 2
        hit = np.flatnonzero(low >= 0)
        return pa.RecordBatch.from_arrays([pa.array(anchor[hit]), pa.array(ctx[hit]), pa.array((-high[hit]).astype(np.int32)), pa.array((length - low[hit]).astype(np.int32))], names=["anchor", "ctx", "start", "end"])

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, t) for t in (np.int64, np.int64, np.int8, np.int32)] + [[]]
        for batch in batches:
            for k in range(0, batch.num_rows, CHUNK):
                part = batch.slice(k, CHUNK)
                now = [part.column(c).to_numpy(zero_copy_only=False) for c in range(4)]
                held = [*(np.concatenate(x) for x in zip(held[:4], now, strict=True)), held[4] + [x.as_py() for x in part.column(4)]]
                if len(held[4]) >= CHUNK:
                    end = int(np.searchsorted(held[0], held[0][-1]))  # the last gram's rows may go on
                    if end:
                        yield flush([x[:end] for x in held])
                        held = [x[end:] for x in held]
        yield flush(held)

    few = rows.select("anchor", "ctx", "slot", "before", "bytes").repartition("anchor").sortWithinPartitions("anchor", "ctx", "slot")
    return few.mapInArrow(make, "anchor long, ctx long, start int, end int")


def banded(rows: DataFrame, length: int, wide: int, step: int) -> DataFrame:
    """rows of hot grams by bands of `step` columns: the windows of a band share a longer core, which is the band's gram.

    anchor becomes the hash of old anchor, band and core, and ctx that of the band's windows; of, from and shift tell what
    they were. The core of columns a to a + step - 1 holds all but step - 1 bytes of each of their windows.
    """

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for anchor, ctx, slot, before, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for a in range(0, wide + 1, step):
                    b = min(a + step - 1, wide, before)  # the last column of this context in the band
                    low = max(a, length - (len(text) - before))  # the first
                    if low > b:
                        continue
                    top = min(a + step - 1, wide)
                    core = text[before - a : before - top + length]
                    own = text[before - b : before - low + length]
                    name = hashlib.blake2b(b"%d/%d/%d/" % (anchor, step, a) + core, digest_size=8).digest()
                    inner = hashlib.blake2b(b"%d/%d/" % (b, low) + own, digest_size=8).digest()
                    out.append((int.from_bytes(name, "big", signed=True), int.from_bytes(inner, "big", signed=True), slot, b - a, own, anchor, ctx, a))
                if len(out) >= CHUNK:
                    yield batched(out)
                    out = []
            yield batched(out)

    def batched(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (*BYTES_TYPES, pa.int64(), pa.int64(), pa.int32())
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=[x.split()[0] for x in f"{BYTES}, of long, from long, shift int".split(", ")])

    return rows.select("anchor", "ctx", "slot", "before", "bytes").mapInArrow(make, f"{BYTES}, `of` long, `from` long, shift int")


def hot_anchors(contexts: DataFrame, hot: int) -> DataFrame:
    """The grams of more than `hot` contexts; contexts: anchor and ctx, each pair once."""
    return written(contexts.groupBy("anchor").agg(F.count(F.lit(1)).alias("different")).where(F.col("different") > hot).select("anchor"), "hot")


def all_repeated(rows: DataFrame, many: DataFrame, length: int, wide: int, hot: int, steps: tuple[int, ...] = STEPS) -> DataFrame:
    """repeated(), with the grams in `many` (those of more than `hot` contexts) expanded a band of columns at a time.

    A band's contexts that are alike are one (and, if they come from two, enter twice); bands whose core is still hot are cut
    to single columns, whose core is the window: there all contexts are alike.
    """
    if not steps or not many.head(1):
        return repeated(rows, length, wide)
    rows, step = written(rows, "cut"), steps[0]
    spans = repeated(rows.join(many, "anchor", "left_anti"), length, wide)
    bands = written(banded(rows.join(many, "anchor", "left_semi").dropDuplicates(["anchor", "ctx", "slot"]), length, wide, step), "bands")
    one = written(bands.groupBy("anchor", "ctx").agg(F.count(F.lit(1)).alias("times"), F.min("before").alias("before"), F.min("bytes").alias("bytes")), "band-contexts")
    twice = one.withColumn("slot", F.explode(F.expr("if(times > 1, array(0Y, 1Y), array(0Y))")))
    found = all_repeated(twice.select("anchor", "ctx", "slot", "before", "bytes"), hot_anchors(one, hot), length, step - 1, hot, steps[1:])
    back = bands.join(found, ["anchor", "ctx"]).select(F.col("of").alias("anchor"), F.col("from").alias("ctx"), (F.col("start") - F.col("shift")).alias("start"), (F.col("end") - F.col("shift")).alias("end"))
    return spans.unionByName(back)


def finished(texts: DataFrame) -> DataFrame:
    """key, n, n_removed, n_spans and kept_sha256 of each text (z) with its spans."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            out = []
            for z, spans in zip(batch.column(2), batch.column(3), strict=True):
                text, runs = unpack.decompress(z.as_py()), []
                for x in sorted((s["start"], s["end"]) for s in spans.as_py()):
                    if runs and x[0] <= runs[-1][1]:
                        runs[-1][1] = max(runs[-1][1], x[1])
                    else:
                        runs.append(list(x))
                kept, at = hashlib.sha256(), 0
                for a, b in runs:
                    kept.update(text[at:a])
                    at = b
                kept.update(text[at:])
                out.append((sum(b - a for a, b in runs), len(runs), kept.hexdigest()))
            made = [pa.array([r[k] for r in out], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.string()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *made], names=["key", "n", "n_removed", "n_spans", "kept_sha256"])

    return texts.select("key", "n", "z", "spans").mapInArrow(make, "key long, n int, n_removed long, n_spans long, kept_sha256 string")


def deduplicated(docs: DataFrame, length: int = LENGTH, hot: int | None = None) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of each document, and its spans (start, end in bytes).

    hot: the contexts of a gram that one task expands (HOT); those of others are dealt out.
    """
    hot = HOT if hot is None else hot
    if length < 2 * GRAM:
        raise ValueError(f"length must be at least {2 * GRAM}")
    text = F.coalesce("text", F.lit(""))
    docs = kept_columns(docs, ["doc_id", "text"]).select("doc_id", text.alias("text"), F.xxhash64(text).alias("key"), F.octet_length(text).alias("n"))
    rows = written(anchored(docs.where(F.col("n") >= length), length), "anchors")
    again = written(rows.groupBy("anchor").agg(F.count(F.lit(1)).alias("times")).where("times > 1").select("anchor"), "grams")
    shared = written(rows.join(again, "anchor", "left_semi"), "shared")
    dropped(rows)
    dropped(again)
    place = F.struct("key", "n", "at", "before", "after")
    distinct = written(shared.groupBy("anchor", "ctx").agg(F.count(F.lit(1)).alias("times"), F.min(place).alias("one"), F.max(place).alias("other")), "contexts")
    many = hot_anchors(distinct, hot)
    both = F.array(F.struct(F.lit(0).cast("byte").alias("slot"), "one"), F.struct(F.lit(1).cast("byte").alias("slot"), F.col("other").alias("one")))
    slots = distinct.select("anchor", "ctx", F.explode(F.when(F.col("times") > 1, both).otherwise(F.slice(both, 1, 1))).alias("x"))
    need = slots.select("x.one.key", "x.one.n", F.struct("anchor", "ctx", "x.slot", "x.one.at", "x.one.before", "x.one.after").alias("x"))
    need = need.groupBy("key", "n").agg(F.collect_list("x").alias("need"))  # of one text, so bounded by its length
    wanted = written(shared.select("key", "n").distinct().join(need, ["key", "n"], "left"), "wanted")
    texts = written(packed(docs.where(F.col("n") >= length)).join(wanted, ["key", "n"]), "texts")
    dropped(wanted)
    dropped(distinct)
    spans = all_repeated(cut(texts.where("need is not null")), many, length, length - GRAM, hot)
    marks = written(spans.groupBy("anchor", "ctx").agg(F.min("start").alias("start"), F.max("end").alias("end")), "marks")
    gone = shared.join(marks, ["anchor", "ctx"]).select("key", "n", (F.col("at") + F.col("start")).alias("start"), (F.col("at") + F.col("end")).alias("end")).distinct()
    gone = written(gone.groupBy("key", "n").agg(F.collect_list(F.struct("start", "end")).alias("spans")), "spans")
    for x in (shared, marks):
        dropped(x)
    done = finished(texts.select("key", "n", "z").join(gone, ["key", "n"])).dropDuplicates(["key", "n"])
    done = written(done.join(gone, ["key", "n"]), "done")
    dropped(texts)
    dropped(gone)
    own = docs.select("doc_id", "key", "n", F.sha2(F.encode("text", "UTF-8"), 256).alias("own"))
    out = own.join(done, ["key", "n"], "left")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return out.select("doc_id", F.col("n").cast("long").alias("n_bytes"), zero("n_removed"), zero("n_spans"), F.coalesce("kept_sha256", "own").alias("kept_sha256"), "spans")


def op9_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicated(table(spark, sf_dir, "documents")).drop("spans")


OP9_SQL = """
with d as (select doc_id, encode(coalesce(text, '')) as t, hex(encode(coalesce(text, ''))) as h from documents),
w as (select doc_id, k, md5(array_slice(t, k + 1, k + 200)) as s from (select doc_id, t, unnest(generate_series(0, octet_length(t) - 200)) as k from d where octet_length(t) >= 200)),
r as (select s from w group by s having count(*) > 1),
m as (select doc_id, k, k - coalesce(lag(k) over (partition by doc_id order by k), -1000) > 200 as fresh from w semi join r using (s)),
g as (select doc_id, k, sum(fresh::int) over (partition by doc_id order by k) as g from m),
x as (select doc_id, min(k) as a, max(k) + 200 as b from g group by doc_id, g),
e as (select doc_id, a, b, coalesce(lag(b) over (partition by doc_id order by a), 0) as before from x),
k as (select doc_id, sum(b - a) as n_removed, count(*) as n_spans, string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' order by a) || substr(any_value(h), 2 * max(b) + 1) as kept from e join d using (doc_id) group by doc_id)
select doc_id, (length(h) // 2)::bigint as n_bytes, coalesce(n_removed, 0)::bigint as n_removed, coalesce(n_spans, 0)::bigint as n_spans, sha256(unhex(coalesce(kept, h))) as kept_sha256 from d left join k using (doc_id)
"""
