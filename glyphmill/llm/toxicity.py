"""Toxicity by non-negative positive-unlabelled learning.

Positives are documents whose label says toxic; the unlabelled text is that of labelled rows, whatever their label says. A linear model over
words, byte n-grams within words and beginnings of words is fitted in numpy by minimising prior * R+ + max(0, Ru - prior * R-), the risk
corrected by the class prior (the toxic share among labelled rows of the training folds) and kept from going negative.

Fitting takes a bounded sample of labelled rows, by a hash of doc_id: at most `positives` toxic texts and `unlabelled` of
any label, whole and each once, however many rows share a doc_id; features are counted by Spark and the `features` strongest are kept, so that the driver only sees sparse rows of
them. Scoring takes every document; the model it sends to the tasks has a fixed size.

A null or empty text scores by the model's intercept. A null doc_id counts as an empty string in the fold and has no
label; of repeated labels of one doc_id the largest counts. Without positives, or without documents, all scores are 0.
Repeated rows are scored each; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import dropped, joined, slices, table, utf8, written
from .words import LOWER, Words, mixed

FOLDS, POSITIVES, UNLABELLED, FEATURES, BITS = 5, 3000, 9000, 1024, 20
GRAMS, STEMS, LEAST_Z, LEAST_SHARE = (4, 5, 6), (5, 6, 7, 8), 5.0, 0.02
STEPS, RATE, DECAY, SLACK, PART_BYTES = 800, 0.05, 3e-4, 0.0, 1 << 18
LETTER = np.zeros(256, bool)
LETTER[97:123] = LETTER[128:] = True


class Model(NamedTuple):
    place: np.ndarray  # of each hash bucket, its feature's index or -1
    weight: np.ndarray
    intercept: float


def fold(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % FOLDS


def buckets(raw: np.ndarray, off: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Text index and hash bucket of each feature's occurrences in lowered texts: words, n-grams inside words, and what words begin with."""
    shift = np.uint64(64 - BITS)
    w = Words(raw, off, LETTER)
    yield w.text, (w.hash >> shift).astype(np.int64)
    letter = LETTER[raw]
    goes_on = letter.copy()
    goes_on[off[:-1][off[:-1] < len(raw)]] = False
    of = np.repeat(np.arange(len(off) - 1), np.diff(off))
    for n in GRAMS:
        m = len(raw) - n + 1
        if m <= 0:
            continue
        ok, code = letter[:m].copy(), raw[:m].astype(np.uint64)
        for k in range(1, n):
            ok &= goes_on[k : k + m]
            code = code << np.uint64(8) | raw[k : k + m].astype(np.uint64)
        at = np.flatnonzero(ok)
        yield of[at], (mixed(code[at] + np.uint64(n << 56)) >> shift).astype(np.int64)
    for n in STEMS:
        long = np.flatnonzero(w.end - w.start >= n)
        code = np.zeros(len(long), np.uint64)
        for k in range(n):
            code = code * np.uint64(0x100000001B3) + raw[w.start[long] + k].astype(np.uint64)
        yield w.text[long], (mixed(code + np.uint64(n << 56 | 1 << 55)) >> shift).astype(np.int64)


def present(part: pa.RecordBatch, column: int, place: np.ndarray, features: int) -> np.ndarray:
    """Which features each text of a slice has: a row of booleans a text."""
    out = np.zeros((part.num_rows, features), bool)
    raw, off = joined(utf8(part.column(column)))
    for text, bucket in buckets(LOWER[raw], off):
        at = place[bucket]
        hit = at >= 0
        out[text[hit], at[hit]] = True
    return out


def chosen(sample: DataFrame, features: int) -> list[int]:
    """The buckets that set positives (toxic = 1) of the sample most apart from the rest, by a two-proportion z score.

    A bucket must be in LEAST_SHARE of the positives, so that what a few near copies of one text share doesn't count.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, docs = np.zeros((2, 1 << BITS), np.int64), np.zeros(2, np.int64)
        for batch in batches:
            for part in slices(batch, most=PART_BYTES):
                raw, off = joined(utf8(part.column(0)))
                toxic = part.column(1).to_numpy(zero_copy_only=False)
                docs += np.bincount(toxic, minlength=2)
                found = [np.unique(t << BITS | b) for t, b in buckets(LOWER[raw], off)]
                pairs = np.unique(np.concatenate(found))
                np.add.at(seen, (toxic[pairs >> BITS], pairs & ((1 << BITS) - 1)), 1)
        at = np.flatnonzero(seen.any(0))
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(seen[0][at], docs[0])), pa.array(np.append(seen[1][at], docs[1]))], names=["bucket", "rest", "toxic"])

    counts = written(sample.mapInArrow(count, "bucket long, rest long, toxic long").groupBy("bucket").agg(F.sum("rest").alias("rest"), F.sum("toxic").alias("toxic")), "features")
    total = counts.where("bucket = -1").first()
    if not total or not total.rest or not total.toxic:
        return []
    p, u = F.col("toxic") / total.toxic, F.col("rest") / total.rest
    both = (F.col("toxic") + F.col("rest") + 1) / (total.toxic + total.rest + 2)
    z = (p - u) / F.sqrt(both * (1 - both) * (1 / total.toxic + 1 / total.rest))
    strong = counts.where((F.col("bucket") >= 0) & (z >= LEAST_Z) & (p >= LEAST_SHARE))
    return [r.bucket for r in strong.orderBy(z.desc(), "bucket").limit(features).collect()]


def fitted(x: np.ndarray, toxic: np.ndarray, prior: float, steps: int = STEPS) -> tuple[np.ndarray, float]:
    """Weights and intercept of the least non-negative PU risk with logistic loss, by Adam on all rows."""
    x = x.astype(np.float32)
    p, u = toxic == 1, toxic == 0
    theta, first, second = np.zeros(x.shape[1] + 1), np.zeros(x.shape[1] + 1), np.zeros(x.shape[1] + 1)
    theta[-1] = np.log(prior / (1 - prior))
    for step in range(1, steps + 1):
        score = x @ theta[:-1].astype(np.float32) + theta[-1]
        soft = 1 / (1 + np.exp(-score))  # the slope of the negative class's loss; that of the positive class's is soft - 1
        negative = np.logaddexp(0, score)
        risk = negative[u].mean() - prior * negative[p].mean()
        pull = np.zeros(len(x))
        if risk >= SLACK:
            pull[p] = prior * (soft[p] - 1) / p.sum() - prior * soft[p] / p.sum()
            pull[u] = soft[u] / u.sum()
        else:  # the unlabelled part overfits: a step against it
            pull[p] = prior * soft[p] / p.sum()
            pull[u] = -soft[u] / u.sum()
        slope = np.append(x.T @ pull.astype(np.float32), pull.sum()) + DECAY * np.append(theta[:-1], 0)
        first, second = 0.9 * first + 0.1 * slope, 0.999 * second + 0.001 * slope**2
        theta -= RATE * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return theta[:-1], float(theta[-1])


def trained(docs: DataFrame, labels: DataFrame, positives: int = POSITIVES, unlabelled: int = UNLABELLED, features: int = FEATURES) -> Model:
    """A model from docs (doc_id, text) and labels (doc_id, toxic) outside the held-out fold."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & (fold(F.col("doc_id")) != 0)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    order = [F.xxhash64(F.col("doc_id")), "doc_id"]
    toxic = known.where("toxic = 1").select("doc_id")
    share = known.agg(F.avg((F.col("toxic") == 1).cast("double")).alias("p")).first().p
    none = Model(np.full(1 << BITS, -1, np.int32), np.zeros(0), -np.inf)
    if not share:
        return none
    few = toxic.orderBy(*order).limit(positives).withColumn("toxic", F.lit(1))
    # unlabelled text is that of labelled rows of any label, which is not looked at: the prior is the toxic share in it
    rest = known.select("doc_id").orderBy(*order).limit(unlabelled).withColumn("toxic", F.lit(0))
    picked = written(few.union(rest), "picked")  # positives + unlabelled rows at most
    rows = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").select(F.xxhash64("text").alias("hash"), "text", "toxic").distinct()  # copies count once
    rows = written(rows, "picked-texts")
    # many rows may share a doc_id, so rows are bounded too
    bounded = [rows.where(f"toxic = {k}").orderBy("hash", "text").limit(n) for k, n in ((1, positives), (0, unlabelled))]
    sample = written(bounded[0].union(bounded[1]).select("text", "toxic").repartition(16), "sample")
    dropped(rows)
    top = chosen(sample, features)
    if not top:
        return none
    place = np.full(1 << BITS, -1, np.int32)
    place[top] = np.arange(len(top))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, most=PART_BYTES):
                rows = np.packbits(present(part, 0, place, len(top)), axis=1)
                yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in rows], pa.binary()), part.column(1)], names=["bits", "toxic"])

    rows = sample.mapInArrow(pack, "bits binary, toxic int").orderBy("toxic", "bits").collect()  # features / 8 bytes a sampled row
    x = np.unpackbits(np.frombuffer(b"".join(r.bits for r in rows), np.uint8).reshape(len(rows), -1), axis=1)[:, : len(top)]
    weight, intercept = fitted(x, np.array([r.toxic for r in rows]), min(max(share, 1e-4), 0.9))
    return Model(place, weight, intercept)


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """docs with score (0 to 1) after its columns."""
    names = [n for n in docs.columns if n != "score"]
    column, sent = names.index("text"), docs.sparkSession.sparkContext.broadcast(tuple(model))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, weight, intercept = sent.value
        for batch in batches:
            for part in slices(batch, most=PART_BYTES):
                sums = present(part, column, place, len(weight)) @ weight + intercept
                with np.errstate(over="ignore"):
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(1 / (1 + np.exp(-sums)))], names=[*names, "score"])

    rows = docs.select(*[f"`{n}`" for n in names])
    return rows.mapInArrow(score, ", ".join([f"`{n}` {t}" for n, t in rows.dtypes] + ["score double"]))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = trained(docs, table(spark, sf_dir, "labels"))
    return scored(docs, model).select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
