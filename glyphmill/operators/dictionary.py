"""Frequency-ranked dictionaries: building, checking, lookup and coverage."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glyphmill.functions.codes import LEXICAL_FIRST, SINGLE_LETTERS, SLOTS

from .tokens import words

# Sizes of dictionaries, and what the row of all is called.
SIZES = (20000, 30000, 40000, 50000, 65000)
TOTAL = "completo"
# End of the fixed values.


def histogram(docs: DataFrame, *keys: str) -> DataFrame:
    """keys, word and n for words that are looked up, which the single letters with codes of their own are not."""
    return words(docs, *keys).where(~F.col("word").isin(*SINGLE_LETTERS)).groupBy(*keys, "word").agg(F.count(F.lit(1)).alias("n"))


def build(counts: DataFrame, size: int) -> DataFrame:
    """ranking, token, word and frequency of the `size` most frequent words, ties by word.

    The limit comes first (a top-N of each task), so the one window without a key sees at most 65,000 rows.
    """
    if not 1 <= size <= SLOTS:
        raise ValueError(f"a dictionary has 1 to {SLOTS} words")
    top = counts.orderBy(F.desc("n"), "word").limit(size)
    rank = F.row_number().over(Window.orderBy(F.desc("n"), "word"))
    return top.select(rank.alias("ranking"), (rank + LEXICAL_FIRST - 1).alias("token"), "word", F.col("n").alias("frequency"))


def summary(dictionary: DataFrame) -> DataFrame:
    return dictionary.agg(F.count(F.lit(1)).alias("size"), F.min("token").alias("first_token"), F.max("token").alias("last_token"))


def validate(dictionary: DataFrame) -> DataFrame:
    """One row: size and the first rule that the dictionary breaks, null if none."""
    repeated = lambda c: F.count(c) - F.count_distinct(c)
    found = dictionary.agg(
        F.count(F.lit(1)).alias("size"), F.min("ranking").alias("low"), F.max("ranking").alias("high"), F.count_distinct("ranking").alias("ranks"),
        F.count_if(F.col("token") != F.col("ranking") + LEXICAL_FIRST - 1).alias("off"), repeated("word").alias("words"), repeated("token").alias("tokens"),
        F.count_if(F.col("ranking").isNull() | F.col("token").isNull() | F.col("word").isNull() | (F.col("word") == "")).alias("blank"),
    )
    error = (
        F.when(F.col("size") == 0, "EMPTY").when(F.col("size") > SLOTS, "TOO_LARGE").when(F.col("blank") > 0, "BLANK_FIELD").when(F.col("words") > 0, "REPEATED_WORD")
        .when(F.col("tokens") > 0, "REPEATED_TOKEN").when((F.col("low") != 1) | (F.col("high") != F.col("size")) | (F.col("ranks") != F.col("size")), "RANKS_NOT_CONSECUTIVE").when(F.col("off") > 0, "TOKEN_NOT_RANK_PLUS_535")
    )
    return found.select("size", error.alias("error"))


def size_status(dictionary: DataFrame, requested: int) -> DataFrame:
    """OK also where the vocabulary is smaller than asked for."""
    return summary(dictionary).withColumn("requested", F.lit(requested)).withColumn("status", F.when(F.col("size") > requested, "TOO_LARGE").otherwise("OK"))


def small(dictionary: DataFrame) -> DataFrame:
    """A dictionary to broadcast: the code space bounds it to 65,000 rows, and a larger one is cut off here as an error."""
    rows = F.row_number().over(Window.orderBy(F.lit(1)))
    checked = dictionary.limit(SLOTS + 1).withColumn("_row", rows).where(F.when(F.col("_row") <= SLOTS, True).otherwise(F.raise_error(F.lit("a dictionary has at most 65,000 words")).cast("boolean")))
    return F.broadcast(checked.drop("_row"))


def held(dictionary: DataFrame) -> DataFrame:
    """A dictionary as a local table, so that plans that use it several times build it once: 65,000 rows at most, by the code space."""
    rows = dictionary.limit(SLOTS + 1).toArrow()
    if rows.num_rows > SLOTS:
        raise ValueError("a dictionary has at most 65,000 words")
    return dictionary.sparkSession.createDataFrame(rows.to_pylist(), dictionary.schema)


def lookup(rows: DataFrame, dictionary: DataFrame, how: str = "left") -> DataFrame:
    """rows (column word) with token: left keeps misses, left_semi and left_anti tell hits and misses."""
    return rows.join(small(dictionary.select("word", "token")), "word", how)


def require(rows: DataFrame, dictionary: DataFrame) -> DataFrame:
    """lookup() that fails the job on a miss."""
    found = lookup(rows, dictionary)
    return found.withColumn("token", F.coalesce("token", F.raise_error(F.concat(F.lit("not in the dictionary: "), F.col("word"))).cast("int")))


def covered(counts: DataFrame, dictionary: DataFrame, *keys: str) -> DataFrame:
    """keys, total, covered, outside and coverage (percent, 6 decimals) of a histogram's occurrences."""
    inside = F.coalesce(F.sum(F.when(F.col("token").isNotNull(), F.col("n"))), F.lit(0))
    out = lookup(counts, dictionary).groupBy(*keys).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"), inside.alias("covered"))
    share = F.when(F.col("total") == 0, 0.0).otherwise(F.round(100.0 * F.col("covered") / F.col("total"), 6))
    return out.withColumn("outside", F.col("total") - F.col("covered")).withColumn("coverage", share)


def coverage_by_size(counts: DataFrame, sizes: Sequence[int] = SIZES) -> DataFrame:
    """requested, vocabulary, selected, first_token, last_token, total, covered, outside and coverage for each size.

    One ranking of the largest size serves all: a word of rank r is in each dictionary of at least r words.
    """
    ranked = build(counts, max(sizes))
    vocabulary = counts.agg(F.count(F.lit(1)).alias("vocabulary"), F.coalesce(F.sum("n"), F.lit(0)).alias("total"))
    each = ranked.crossJoin(F.broadcast(counts.sparkSession.createDataFrame([(s,) for s in sizes], "requested int"))).where("ranking <= requested")
    by = each.groupBy("requested").agg(F.count(F.lit(1)).alias("selected"), F.min("token").alias("first_token"), F.max("token").alias("last_token"), F.sum("frequency").alias("covered"))
    out = by.crossJoin(F.broadcast(vocabulary))
    return out.withColumn("outside", F.col("total") - F.col("covered")).withColumn("coverage", F.round(100.0 * F.col("covered") / F.col("total"), 6))


def coverage_rollup(counts: DataFrame, dictionary: DataFrame, key: str, total: str = TOTAL) -> DataFrame:
    """covered() for each key and for all together."""
    inside = F.coalesce(F.sum(F.when(F.col("token").isNotNull(), F.col("n"))), F.lit(0))
    out = lookup(counts, dictionary).rollup(key).agg(F.grouping(key).alias("all"), F.sum("n").alias("total"), inside.alias("covered"))
    out = out.withColumn(key, F.when(F.col("all") == 1, total).otherwise(F.col(key))).drop("all")
    return out.withColumn("outside", F.col("total") - F.col("covered")).withColumn("coverage", F.round(100.0 * F.col("covered") / F.col("total"), 6))
