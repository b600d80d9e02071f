"""Evaluation: round trips, collisions, benchmark rows and their upsert."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphmill.functions.text import first_difference, percent

from .codec import COUNTERS, decode, measured

KEY = ("dictionary", "dictionary_size", "dataset")


def outcome() -> Column:
    """Of a document: OK, CODEC_EXCEPTION, ROUNDTRIP_MISMATCH or STATISTICS_ERROR."""
    agrees = (F.col("encoded_bytes") == F.col("stream_bytes")) & (F.col("implicit_spaces") == F.col("reconstructed_implicit_spaces")) & (F.col("lexical_items") == F.col("decoded_lexical")) & (F.col("modifier_items") == F.col("decoded_modifiers"))
    return F.when(F.col("error").isNotNull(), "CODEC_EXCEPTION").when(~F.col("text").eqNullSafe(F.col("decoded")), "ROUNDTRIP_MISMATCH").when(~agrees, "STATISTICS_ERROR").otherwise("OK")


def round_trip(docs: DataFrame, dictionary: DataFrame, key: str = "doc_id", *columns: str) -> DataFrame:
    """Per document: the encoder's statistics, the decoder's, outcome and difference (index, left, right; null if equal)."""
    stats = measured(docs, dictionary, key, *columns)
    names = [n for n in stats.columns if n not in (key, "encoded")]
    carried = stats.select(key, "encoded", F.struct(*names).alias("stats"))
    back = decode(carried, dictionary, key, "stats")
    back = back.select(key, "stats", F.col("text").alias("decoded"), "error", F.col("encoded_bytes").alias("stream_bytes"), F.col("lexical_items").alias("decoded_lexical"), F.col("modifier_items").alias("decoded_modifiers"), "reconstructed_implicit_spaces")
    rows = back.select(key, "stats.*", *back.columns[2:])
    return rows.withColumn("outcome", outcome()).withColumn("difference", F.when(~F.col("text").eqNullSafe(F.col("decoded")), first_difference(F.coalesce("text", F.lit("")), F.coalesce("decoded", F.lit(""))))).drop("decoded")


def collisions(encoded: DataFrame, docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """Digests of code streams that come from several texts."""
    rows = encoded.select(key, F.sha2("encoded", 256).alias("digest")).join(docs.select(key, F.sha2("text", 256).alias("text")), key)
    return rows.groupBy("digest").agg(F.count_distinct("text").alias("texts"), F.count(F.lit(1)).alias("documents")).where("texts > 1")


def classifier(correct: Column, evaluated: Column, exceptions: Column, statistics_errors: Column) -> Column:
    return F.when((correct != evaluated) | (exceptions > 0), "CODEC_OR_ROUNDTRIP_ERROR").when(statistics_errors > 0, "STATISTICS_ERROR").otherwise("OK")


def report(rows: DataFrame, dictionary: DataFrame, name: str, dataset: str | Column, *keys: str) -> DataFrame:
    """Benchmark rows of round_trip() rows: a document that failed counts as evaluated but adds no bytes."""
    good = F.col("outcome") != "CODEC_EXCEPTION"
    sums = ["characters", "utf8_bytes", "encoded_bytes", *COUNTERS]
    out = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("documents_evaluated"), F.count_if(F.col("outcome").isin("OK", "STATISTICS_ERROR")).alias("round_trip_correct"), F.count_if(F.col("outcome") == "ROUNDTRIP_MISMATCH").alias("round_trip_errors"),
        F.count_if(~good).alias("codec_exceptions"), F.count_if(F.col("outcome") == "STATISTICS_ERROR").alias("statistics_errors"), *[F.coalesce(F.sum(F.when(good, F.col(c))), F.lit(0)).alias(c) for c in sums],
    )
    size = dictionary.agg(F.count(F.lit(1)).cast("int").alias("dictionary_size"), F.min("token").alias("first_token"), F.max("token").alias("last_token"))
    out = out.crossJoin(F.broadcast(size))  # one row
    saved = F.col("utf8_bytes") - F.col("encoded_bytes")
    return out.withColumns({
        "dictionary": F.lit(name), "dataset": dataset if isinstance(dataset, Column) else F.lit(dataset), "difference_bytes": saved, "reduction_percentage": F.round(percent(saved, F.col("utf8_bytes")), 6),
        "round_trip_success_percentage": F.round(percent(F.col("round_trip_correct"), F.col("documents_evaluated")), 6),
        "result": classifier(F.col("round_trip_correct"), F.col("documents_evaluated"), F.col("codec_exceptions"), F.col("statistics_errors")),
    })


def upsert(existing: DataFrame, new: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """existing with new rows in place of those of equal key, the rest appended; ordered by dataset and size.

    The new rows of a run are few, but nothing relies on it: the join's strategy is Spark's to choose.
    """
    if sorted(existing.columns) != sorted(new.columns):
        raise ValueError("the columns differ")
    return existing.join(new.select(*key), list(key), "left_anti").select(*existing.columns).unionByName(new).orderBy("dataset", "dictionary_size", "dictionary")


def worst(rows: DataFrame, key: str = "doc_id", most: int = 10) -> DataFrame:
    """The first failures, by key."""
    return rows.where("outcome <> 'OK'").orderBy(key).limit(most).select(key, "outcome", "error", "difference")


def described(rows: DataFrame) -> DataFrame:
    """represent() rows as one line of text each."""
    code = F.when(F.col("code").isNotNull(), F.concat(F.lit(" code="), F.col("code"))).otherwise("")
    modifier = F.when(F.col("modifier") != "NONE", F.concat(F.lit(" "), F.col("modifier"))).otherwise("")
    return rows.withColumn("line", F.concat(F.col("kind"), F.lit(" '"), F.col("token"), F.lit("'"), code, modifier))


__all__ = ["classifier", "collisions", "described", "outcome", "report", "round_trip", "upsert", "worst"]
