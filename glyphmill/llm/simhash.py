"""SimHash near-duplicates by Golay-code fuzzy hashing.

A fingerprint of 64 bits is cut into three segments of at most 23 bits. The binary Golay code decodes a segment to the
index of its nearest codeword and, if that is three bits off, to the five at four bits: of two segments that differ in one
bit or none, the nearest codeword of one is near the other. At most three errors leave a segment without any and another with one
at most, unless each segment has one. So two fingerprints that near agree in a segment and on a near codeword of another, or
on near codewords of all three: keys of 31 or 32 bits. One side emits nearest codewords, the other all near ones (of
three, one side emits two nearest and the other the third). Equal keys meet, the distance is verified, and components are taken.

Three bits of one fingerprint only tell copies with very few edits. similar() finds documents whose shingle sets have a
given Jaccard similarity: a document gives the fingerprints of several samples of its shingles, drawn by min-hash so that
similar documents draw the same ones; those that share a sample's fingerprint meet in the same blocks. A longer sketch only
passes over pairs far below the similarity: exact() brings the rest together and verifies them on their shingle sets.

Equal fingerprints are one node throughout. Keys that many fingerprints share are dealt out as a grid of blocks of at
most `block_rows` rows a side, so that no task gets a whole one; a task keeps only a spanning forest of its links.

A null or empty text has fingerprint 0, linked like any other. Repeated rows are documents of their own. A null doc_id is
passed over as a component's id unless all of its are null. Empty tables give no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import dropped, joined, kept_columns, matched, sieve, slices, table, utf8, written
from .graph import components
from .suffixes import packed
from .words import mixed, repeats, shingle_sets

SEGMENTS, DISTANCE, SHINGLE, SEED = (22, 21, 21), 3, 3, 42
#: The segment that has no error and the one that has one at most.
PAIRS_OF_SEGMENTS = ((0, 1), (0, 2), (1, 0), (1, 2), (2, 0), (2, 1))
#: PAIRS and FOREST bound what a task holds at a time, not what it finds.
BLOCK_ROWS, TASK_PRINTS, BLOCK_SHINGLES, PAIRS, FOREST = 8192, 1 << 13, 1 << 18, 1 << 18, 1 << 17
#: Samples of a document for similar(): 0.99 of pairs at 0.8 share one of 9 of 4 shingles' min-hashes.
BANDS, ROWS, SKETCH, CELLS, PROFILE_BYTES = 9, 4, 128, 1 << 19, 1 << 18
#: Standard errors of the sketch's estimate below the similarity at which a pair is still a candidate.
MARGIN = 5.0
#: x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1 generates the Golay code of 23 bits, 12 of them information.
GENERATOR, LENGTH, PARITY = 0b110001110101, 23, 11


def remainder(word: int) -> int:
    for k in range(LENGTH - 1, PARITY - 1, -1):
        if word >> k & 1:
            word ^= GENERATOR << (k - PARITY)
    return word


def golay(width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For segments of `width` bits: syndromes of the upper bits; by syndrome, errors to near codewords (first the nearest), and how many."""
    upper = np.array([remainder(h << PARITY) for h in range(1 << (LENGTH - PARITY))], np.int64)
    single = [remainder(1 << k) for k in range(LENGTH)]
    leader = {0: 0}
    for a in range(LENGTH):
        leader[single[a]] = 1 << a
        for b in range(a):
            leader[single[a] ^ single[b]] = 1 << a | 1 << b
            for c in range(b):
                leader[single[a] ^ single[b] ^ single[c]] = 1 << a | 1 << b | 1 << c
    errors, counts = np.zeros((1 << PARITY, 6), np.int64), np.zeros(1 << PARITY, np.int64)
    for syndrome, error in leader.items():
        near = dict.fromkeys([error, *((1 << k) ^ leader[syndrome ^ single[k]] for k in range(width))])
        errors[syndrome, : len(near)], counts[syndrome] = list(near), len(near)
    return upper, errors, counts


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """64 bits, each set if it is in over half the shingle hashes."""
    h = shingle_hashes(text, shingle)
    if not len(h):
        return 0
    ones = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view(np.uint64)[0])


def fingerprinted(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id and fp, the fingerprint as a signed long."""
    kind = dict(docs.dtypes)["doc_id"]

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(x.as_py(), shingle) for x in utf8(batch.column(1))], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], names=["doc_id", "fp"])

    return kept_columns(docs, ["doc_id", "text"]).mapInArrow(make, f"doc_id {kind}, fp long")


class Keys:
    """The fuzzy keys of fingerprints."""

    def __init__(self):
        self.shift = np.cumsum([0, *SEGMENTS[:-1]])
        self.tables = [golay(w) for w in SEGMENTS]

    def codes(self, fp: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each segment the indices of near codewords, six columns of which the first is the nearest, and how many hold."""
        out = []
        for shift, width, (upper, errors, counts) in zip(self.shift.tolist(), SEGMENTS, self.tables, strict=True):
            word = (fp >> np.uint64(shift) & np.uint64((1 << width) - 1)).astype(np.int64)
            syndrome = word & ((1 << PARITY) - 1) ^ upper[word >> PARITY]
            out.append(((word[:, None] ^ errors[syndrome]) >> PARITY, counts[syndrome]))
        return out

    def __call__(self, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """key, side (0 or 1) and row of each key."""
        codes, bits, every = self.codes(fp), LENGTH - PARITY, np.arange(len(fp))
        exact = [(fp >> np.uint64(shift) & np.uint64((1 << width) - 1)).astype(np.int64) for shift, width in zip(self.shift.tolist(), SEGMENTS, strict=True)]
        nearest = [near[:, 0] for near, _ in codes]
        keys, sides, rows = [], [], []

        def put(kind: int, side: int, row: np.ndarray, key: np.ndarray) -> None:
            keys.append(kind << 40 | key)
            sides.append(np.full(len(row), side, np.int8))
            rows.append(row)

        def all_near(segment: int) -> tuple[np.ndarray, np.ndarray]:
            near, count = codes[segment]
            row = np.repeat(every, count)
            return row, near[row, repeats(np.zeros(len(fp), np.int64), count)]

        for kind, (same, other) in enumerate(PAIRS_OF_SEGMENTS):
            put(kind, 0, every, exact[same] << bits | nearest[other])
            row, code = all_near(other)
            put(kind, 1, row, exact[same][row] << bits | code)
        (first, a), (second, b), (third, c) = (all_near(k) for k in range(3))
        put(len(PAIRS_OF_SEGMENTS), 0, third, (nearest[0][third] << bits | nearest[1][third]) << bits | c)
        count = codes[1][1][first]  # of both others all near ones: each of the first with each of the second
        row, at = np.repeat(first, count), repeats((np.cumsum(codes[1][1]) - codes[1][1])[first], count)
        put(len(PAIRS_OF_SEGMENTS), 1, row, (np.repeat(a, count) << bits | b[at]) << bits | nearest[2][row])
        return np.concatenate(keys), np.concatenate(sides), np.concatenate(rows)


def keyed(fps: DataFrame) -> DataFrame:
    """key, side and fp for each fuzzy key of the distinct fingerprints in column fp.

    A fingerprint has some 70 keys, so they are dealt out by their number of keys and not by their own size.
    """
    least = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    fps = fps.select("fp").repartition(max(least, -(-fps.count() // TASK_PRINTS)), F.xxhash64("fp"))  # by another key than theirs, which Spark would coalesce

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = Keys()
        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for k in range(0, len(fp), 4096):
                part = fp[k : k + 4096]
                key, side, row = of(part)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(side), pa.array(part[row].view(np.int64))], names=["key", "side", "fp"])

    return fps.select("fp").mapInArrow(make, "key long, side byte, fp long")


def forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of links: each node that isn't its component's least, and that least."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    root = np.arange(len(nodes))
    while True:
        x, y = root[a], root[b]
        if not (differ := x != y).any():
            break
        a, b, x, y = a[differ], b[differ], x[differ], y[differ]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(root, up := root[root]):
            root = up
    low = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[low], nodes[root[low]]


class Links:
    """Links found by a task, kept as a spanning forest."""

    def __init__(self):
        self.held, self.size = [], 0

    def add(self, u: np.ndarray, v: np.ndarray) -> None:
        if len(u):
            self.held.append((u, v))
            self.size += len(u)
            if self.size > FOREST:
                self.cut()

    def cut(self) -> tuple[np.ndarray, np.ndarray]:
        u, v = forest(*(np.concatenate(x) for x in zip(*self.held, strict=True))) if self.held else (np.zeros(0, np.int64),) * 2
        self.held, self.size = [(u, v)], len(u) // 2  # half, so that a large forest isn't cut again at once
        return u, v


def numbers(column: pa.Array) -> np.ndarray:
    """A column as an array; binaries of one length as rows of bytes."""
    if pa.types.is_binary(column.type):
        raw, off = joined(column)
        return raw.reshape(len(column), -1 if len(column) else 0)
    return column.to_numpy(zero_copy_only=False)


class Best:
    """The most similar other of each node that a task has seen."""

    def __init__(self):
        self.held, self.size = [], 0

    def add(self, u: np.ndarray, v: np.ndarray, score: np.ndarray) -> None:
        if len(u):
            self.held.append((np.concatenate([u, v]), np.concatenate([v, u]), np.concatenate([score, score])))
            self.size += 2 * len(u)
            if self.size > FOREST:
                self.cut()

    def cut(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if not self.held:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        u, v, score = (np.concatenate(x) for x in zip(*self.held, strict=True))
        order = np.lexsort((v, -score, u))
        u, v, score = u[order], v[order], score[order]
        one = np.concatenate([[True], u[1:] != u[:-1]])
        self.held, self.size = [(u[one], v[one], score[one])], int(one.sum()) // 2
        return self.held[0]


def linked(group: np.ndarray, rows: list[np.ndarray], test: Callable, pairs: int, links: Links, best: Best | None = None) -> None:
    """Adds the pairs of each group's sides that pass test; rows (block, key, side, fp, ...) are sorted by group and side."""
    side, fp = rows[2], rows[3]
    first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])) if len(group) else np.zeros(0, np.int64)
    size = np.diff(np.concatenate([first, [len(group)]]))
    own = np.repeat(side[first] == 2, size) if len(first) else np.zeros(0, bool)
    left = np.add.reduceat(side == 0, first).astype(np.int64) if len(first) else size
    end = np.repeat(first + size, size)
    row = np.flatnonzero(own | (side == 0))  # each row that meets others, and those: the later ones, or side 1
    to = np.where(own[row], row + 1, np.repeat(first + left, size)[row])
    count = end[row] - to
    done = np.concatenate([[0], np.cumsum(count)])
    at = 0
    while at < len(row):
        stop = max(at + 1, int(np.searchsorted(done, done[at] + pairs, "right")) - 1)
        a, b = np.repeat(row[at:stop], count[at:stop]), repeats(to[at:stop], count[at:stop])
        near = np.flatnonzero(fp[a] != fp[b])
        if best is None:
            near = near[test(rows, a[near], b[near])]
        else:
            ok, score = test(rows, a[near], b[near])
            near = near[ok]
            best.add(fp[a[near]], fp[b[near]], score[ok])
        if len(near):
            links.add(*forest(fp[a[near]], fp[b[near]]))
        at = stop


def gridded(rows: DataFrame, sides: bool, block_rows: int, weight: Column | None = None) -> DataFrame:
    """dealt() rows, brought together by block."""
    return dealt(rows, sides, block_rows, weight).repartition("block")


def dealt(rows: DataFrame, sides: bool, block_rows: int, weight: Column | None = None) -> DataFrame:
    """rows (key, side, ...) with block: a key's two sides are dealt out as a grid of blocks of at most block_rows rows a side.

    With weight (and without sides) a row counts as that many rows.

    Without sides, all rows of a key are both sides: they are doubled only in keys of more than one block.
    """
    left, right = (F.ceil(F.sum(1 - F.col("side")) / block_rows), F.ceil(F.sum("side") / block_rows)) if sides else (F.ceil((F.count(F.lit(1)) if weight is None else F.sum(weight)) / block_rows),) * 2
    hot = written(rows.groupBy("key").agg(left.alias("left"), right.alias("right")).where("left > 1 or right > 1"), "hot")
    if not sides:
        rows = rows.join(hot.select("key", "left"), "key", "left").withColumn("side", F.explode(F.when(F.col("left") > 1, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(2))))).drop("left")
    out = rows.join(hot, "key", "left").withColumns({"left": F.coalesce("left", F.lit(1)), "right": F.coalesce("right", F.lit(1))})
    own = F.pmod(F.xxhash64("fp"), F.when(F.col("side") == 0, F.col("left")).otherwise(F.col("right"))).cast("int")
    out = out.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), (F.when(F.col("side") == 0, F.col("right")).otherwise(F.col("left")) - 1).cast("int"))))
    grid = F.when(F.col("side") == 0, F.xxhash64("key", "own", "other")).otherwise(F.xxhash64("key", "other", "own"))
    return out.withColumn("block", grid).drop("own", "other", "left", "right")


def met(rows: DataFrame, test: Callable, pairs: int, best: bool = False) -> DataFrame:
    """u and v: a spanning forest, for each task, of the pairs of a block's sides that pass test.

    With best, test gives scores too, and there are rows (u, v, score) of the other with the highest score for each; the
    forest's score is then -1.

    rows: block, key, side (0 and 1 meet; rows of side 2 meet each other), fp and what test takes.
    """

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, tail, top = Links(), None, Best() if best else None
        for batch in batches:
            now = [numbers(batch.column(k)) for k in range(batch.num_columns)]
            now = now if tail is None else [np.concatenate(x) for x in zip(tail, now, strict=True)]
            group = now[0] ^ now[1] * np.int64(0x9E3779B97F4A7C1)  # a block is one key's, but for equal hashes
            cut = int(np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))[-1]) if len(group) else 0
            linked(group[:cut], [x[:cut] for x in now], test, pairs, found, top)
            tail = [x[cut:] for x in now]
        if tail is not None:
            linked(tail[0] ^ tail[1] * np.int64(0x9E3779B97F4A7C1), tail, test, pairs, found, top)
        u, v = found.cut()
        if top is None:
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])
        else:
            for a, b, score in ((u, v, np.full(len(u), -1.0)), top.cut()):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(score)], names=["u", "v", "score"])

    return rows.sortWithinPartitions("block", "key", "side").mapInArrow(find, "u long, v long" + ", score double" * best)


def links(fps: DataFrame, distance: int = DISTANCE, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """u and v: links between distinct fingerprints (column fp) that have the components of all links of at most `distance` bits."""

    def near(rows: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
        bits = rows[3].view(np.uint64)
        return np.bitwise_count(bits[a] ^ bits[b]) <= distance

    return met(gridded(keyed(fps), True, block_rows).select("block", "key", "side", "fp"), near, PAIRS)


def shingle_hashes(text: bytes, shingle: int, seed: int = SEED) -> np.ndarray:
    """XXH64 of each run of `shingle` words (A-Z lowered, single spaces; fewer words: all of them)."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]).tolist()
    starts, last = [0, *ends], max(0, len(words) - shingle)
    digest = xxhash.xxh64_intdigest
    return np.array([digest(line[starts[k] : ends[min(k + shingle, len(words)) - 1] - 1], seed) for k in range(last + 1)], np.uint64)


def min_hashes(h: np.ndarray, first: np.ndarray, n: int, salt: int) -> np.ndarray:
    """For each text (its hashes from first[k] to first[k + 1]) the least value in each of n classes that a hash deals them to.

    A class without any takes the least of a hash of its own.
    """
    texts, none, size = len(first) - 1, np.iinfo(np.uint64).max, np.diff(first)
    x = mixed(h + np.uint64(salt << 32))
    out = np.full(texts * n, none)
    np.minimum.at(out, np.repeat(np.arange(texts), size) * n + (x % np.uint64(n)).astype(np.int64), x)
    empty = np.flatnonzero((out == none) & (np.repeat(size, n) > 0))
    at, ends = 0, np.cumsum(size[empty // n])
    while at < len(empty):  # a few million values at a time
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + CELLS, "right")))
        part = empty[at:to]
        count = size[part // n]
        own = np.repeat(np.uint64(salt << 32 | 1 << 31) + (part % n).astype(np.uint64), count)
        out[part] = np.minimum.reduceat(mixed(h[repeats(first[part // n], count)] + own), np.cumsum(count) - count)
        at = to
    return out.reshape(texts, n)


def profiled(texts: DataFrame, shingle: int, bands: int, rows: int, sketch: int) -> DataFrame:
    """node, print (the fingerprint, repeats counted once), keys (fingerprints of `bands` samples of `rows` shingles) and sketch
    (a byte for each of so many min-hashes) of texts (node, text); a text without words has print 0 and no keys."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for batch in batches:
            fresh = [k for k, x in enumerate(batch.column(0).to_pylist()) if not (x in seen or seen.add(x))]
            for part in slices(batch.take(pa.array(fresh, pa.int64())), most=PROFILE_BYTES):
                h, first = shingle_sets(*joined(utf8(part.column(1))), shingle)
                size = np.diff(first)
                some = np.flatnonzero(size)
                prints, keys = np.zeros(part.num_rows, np.int64), np.zeros((part.num_rows, bands), np.int64)
                if len(some):
                    bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
                    ones = np.add.reduceat(bits, first[some], axis=0, dtype=np.int64)
                    prints[some] = np.packbits(2 * ones > size[some, None], axis=1, bitorder="little").view(np.int64)[:, 0]
                drawn = min_hashes(h, first, bands * rows, 1).reshape(-1, bands, rows)
                ones = np.unpackbits(drawn.view(np.uint8).reshape(-1, bands, rows, 8), axis=3, bitorder="little").sum(2, dtype=np.int64)
                keys = np.packbits(2 * ones > rows, axis=2, bitorder="little").reshape(-1, bands, 8).view(np.int64)[:, :, 0]
                marks = (mixed(min_hashes(h, first, sketch, 2)) >> np.uint64(56)).astype(np.uint8)
                count = np.where(size > 0, bands, 0)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(count)]).astype(np.int32)), pa.array(keys[size > 0].reshape(-1)))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(prints), lists, pa.array([m.tobytes() for m in marks], pa.binary())], names=["node", "print", "keys", "sketch"])

    return texts.select("node", "text").mapInArrow(make, "node long, print long, keys array<long>, sketch binary")


def similar(profiles: DataFrame, similarity: float = 0.8, sketch: int = SKETCH, block_rows: int = 2048) -> DataFrame:
    """u, v and score: candidate links between texts of profiled() that share a sample and may have that similarity.

    A pair is passed over only if its estimate from `sketch` min-hashes is MARGIN standard errors or more below the
    similarity; exact() verifies what is left. Rows with score 0 or more are each text's most similar one in a task, those
    with score -1 a spanning forest of a task's links.
    """
    floor = similarity - MARGIN * (similarity * (1 - similarity) / sketch) ** 0.5
    each = profiles.select(F.posexplode("keys").alias("band", "value"), F.col("node").alias("fp")).select(F.xxhash64("band", "value").alias("key"), "fp")
    shared = written(each.groupBy("key").agg(F.min("fp").alias("low"), F.max("fp").alias("high")).where("low < high").select("key"), "shared")
    pairs = written(each.join(shared, "key").distinct(), "pairs")
    few = dealt(pairs, False, block_rows).select("block", "key", "side", "fp")
    rows = few.join(profiles.select(F.col("node").alias("fp"), "sketch").dropDuplicates(["fp"]), "fp").repartition("block")

    def alike(rows: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        same = (rows[4][a] == rows[4][b]).mean(1)
        near = (same - 1 / 256) / (1 - 1 / 256)  # equal bytes by chance taken off
        return near >= floor, near

    return met(rows.select("block", "key", "side", "fp", "sketch"), alike, 1 << 15, best=True)


def similar_pairs(side: np.ndarray, sets: list[np.ndarray], similarity: float, cells: int = 1 << 21) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of one group's rows whose sets are that similar; rows of side 0 meet those of side 1, of side 2 each other.

    The matrix product is taken over columns in turn, so that no matrix has more than `cells` or rows x rows cells.
    """
    size = np.array([len(s) for s in sets])
    row = np.repeat(np.arange(len(sets)), size)
    values, place, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    common = count > 1  # only values of two rows at least can be shared
    column = np.cumsum(common) - 1
    keep = common[place]
    row, column = row[keep], column[place[keep]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    both, wide = np.zeros((len(sets), len(sets)), np.float32), max(1, cells // len(sets))
    for low in range(0, int(common.sum()), wide):
        part = slice(*np.searchsorted(column, [low, low + wide]))
        has = np.zeros((len(sets), min(wide, int(common.sum()) - low)), np.float32)
        has[row[part], column[part] - low] = 1
        both += has @ has.T
    ok = both >= similarity * (size[:, None] + size[None, :] - both) - 1e-6
    a, b = np.nonzero(np.triu(ok, 1) if side[0] == 2 else ok & (side[:, None] == 0) & (side[None, :] == 1))
    return a, b


def unpacked_sets(shingle: int) -> Callable[[list[bytes]], list[np.ndarray]]:
    """What makes sets of shingle hashes of compressed texts."""

    def make(packed: list[bytes]) -> list[np.ndarray]:
        unpack = zstandard.ZstdDecompressor()
        out: list[np.ndarray] = []
        for part in slices(pa.RecordBatch.from_arrays([pa.array([unpack.decompress(z) for z in packed], pa.binary())], names=["text"])):
            h, first = shingle_sets(*joined(utf8(part.column(0))), shingle)
            out += [h[a:b] for a, b in zip(first[:-1], first[1:], strict=True)]
        return out

    return make


def stored_sets(held: list[bytes]) -> list[np.ndarray]:
    return [np.frombuffer(s, np.uint64) for s in held]


def verified(rows: DataFrame, similarity: float, sets: Callable[[list[bytes]], list[np.ndarray]] = stored_sets) -> DataFrame:
    """u and v: a spanning forest, for each task, of the links in gridded() rows with what their sets are made of (column sets)."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, held, mark = Links(), [], None

        def flush() -> None:
            if len(held) > 1:
                fp = np.array([h[1] for h in held])
                a, b = similar_pairs(np.array([h[0] for h in held]), sets([h[2] for h in held]), similarity)
                differ = fp[a] != fp[b]
                if differ.any():
                    found.add(*forest(fp[a[differ]], fp[b[differ]]))
            held.clear()

        for batch in batches:
            for block, key, side, fp, s in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (block, key) != mark:
                    flush()
                    mark = (block, key)
                held.append((side, fp, s))
        flush()
        u, v = found.cut()
        yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

    return rows.select("block", "key", "side", "fp", "sets").sortWithinPartitions("block", "key", "side").mapInArrow(find, "u long, v long")


def exact(texts: DataFrame, candidates: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """u and v: links between texts (columns node and text) that candidates (u, v, score) join to one component and whose exact shingle sets are that similar.

    First each text is held against its most similar candidate, a pair at a time. That joins most groups whole; in
    components of candidates that are still several groups all pairs are verified, a large one as a grid of blocks, each of about
    `BLOCK_SHINGLES` shingles a side.
    """
    candidates = written(candidates, "links")
    near = written(components(candidates.select("u", "v")), "candidates")
    own = texts.select(F.col("node").alias("key"), F.octet_length("text").alias("n"), "text")
    few = packed(own, sieve(near, "node")).withColumnRenamed("key", "fp").join(near.select(F.col("root").alias("root"), F.col("node").alias("fp")), "fp").dropDuplicates(["fp"])
    few = written(few.select("fp", "root", "n", F.col("z").alias("sets")), "texts")
    top = candidates.groupBy("u").agg(F.max(F.struct("score", "v")).alias("top"))
    pairs = top.select(F.least("u", "top.v").alias("u"), F.greatest("u", "top.v").alias("v")).distinct().withColumn("key", F.xxhash64("u", "v"))
    ends = pairs.select("key", F.explode(F.array("u", "v")).alias("fp")).join(few.select("fp", "sets"), "fp")
    made = unpacked_sets(shingle)
    first = written(verified(ends.withColumns({"block": F.col("key"), "side": F.lit(2)}).repartition("block"), similarity, made), "verified")
    part = near.join(components(first).withColumnRenamed("root", "part"), "node", "left").withColumn("part", F.coalesce("part", "node"))
    open_ = written(part.groupBy("root").agg(F.min("part").alias("low"), F.max("part").alias("high")).where("low < high").select("root"), "open")
    rest = written(few.join(open_, "root").select(F.col("root").alias("key"), "fp", "n", "sets"), "rest")
    weight = F.col("n") / 6 + BLOCK_SHINGLES / 1024
    return verified(gridded(rest, False, BLOCK_SHINGLES, weight).drop("n"), similarity, made).union(first)


def grouped(docs: DataFrame, shingle: int = SHINGLE, distance: int = DISTANCE, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """doc_id, fp and component_id (the least doc_id reachable over links) of each document."""
    if not 0 <= distance <= 3:
        raise ValueError("these segments find up to three differing bits")
    docs = written(fingerprinted(docs, shingle), "fingerprints")
    fps = written(docs.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("times")), "nodes")
    roots = components(links(fps, distance, block_rows))
    nodes = written(fps.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp")), "roots")
    ids = written(nodes.groupBy("root").agg(F.min("first").alias("component_id")), "ids")
    named = written(nodes.join(ids, "root").select("fp", "component_id", "times"), "named")
    for x in (fps, nodes, ids):
        dropped(x)
    return matched(docs, named, ["fp"], "doc_id")


def named(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, distance: int = DISTANCE) -> DataFrame:
    """node (xxhash64 of the text), own (its length and another hash), root (its group) and first (the group's least doc_id)
    of the texts that have near-duplicates or copies.

    Texts are candidates if they share a sample of similar(), or their fingerprints (repeats counted once) are at most
    `distance` bits apart; they are linked if their exact sets of shingles are that similar. Texts without any word are
    one group. Of unlike texts of one node, which 64 bits can't rule out, only those with the least `own` take part.
    """
    own = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("node", F.xxhash64("text"))
    profiles = written(profiled(own, shingle, BANDS, ROWS, SKETCH), "profiles")
    prints = profiles.select(F.col("print").alias("fp"), F.col("node").alias("u")).distinct()
    roots = components(links(prints.select("fp").distinct(), distance)).withColumnRenamed("node", "fp")
    hung = written(prints.join(roots, "fp", "left").select(F.coalesce("root", "fp").alias("fp"), "u"), "hung")
    least = written(hung.groupBy("fp").agg(F.min("u").alias("v"), F.max("u").alias("high")).where("v < high").select("fp", "v"), "least")
    golay = hung.join(least, "fp").where("u <> v").select("u", "v", F.lit(0.0).alias("score"))
    near = components(exact(own, similar(profiles, similarity).union(golay), shingle, similarity))
    ids = own.groupBy("node").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("rows"), F.min(identity("text")).alias("own"))
    both = written(written(ids, "ids").join(near, "node", "left").withColumn("root", F.coalesce("root", "node")), "roots")
    out = both.groupBy("root").agg(F.min("first").alias("first"), F.sum("rows").alias("rows")).where("rows > 1").select("root", "first")
    return written(both.select("node", "own", "root").join(written(out, "firsts"), "root").select("node", "own", "root", "first"), "named")


def identity(text: str) -> Column:
    return F.struct(F.octet_length(text).alias("n"), F.crc32(F.encode(text, "UTF-8")).alias("crc"))


def deduplicated(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, distance: int = DISTANCE) -> DataFrame:
    """docs with one row of each group of near-duplicates: that of the least doc_id, any one of those that repeat it."""
    names = docs.columns
    groups = named(docs, shingle, similarity, distance)
    # the row is one column, so that its names meet none of those used here
    rows = docs.select(F.struct(*[f"`{n}`" for n in names]).alias("row"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.select("row", "doc_id", F.xxhash64("text").alias("node"), identity("text").alias("own"), sieve(groups, "node")(F.xxhash64("text")).alias("maybe"))
    found = rows.where("maybe").join(groups, ["node", "own"], "left")  # only texts that may be in a group are moved
    back = [F.col(f"row.`{n}`").alias(n) for n in names]
    kept = found.where(F.col("root").isNotNull() & F.col("doc_id").eqNullSafe(F.col("first"))).dropDuplicates(["root"])
    return rows.where("not maybe").select(*back).unionByName(found.where("root is null").select(*back)).unionByName(kept.select(*back))


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = grouped(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
