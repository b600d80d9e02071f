"""Writers. Commits are Spark's own: a failed job leaves no half-written result behind."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphmill.operators.evaluate import KEY, upsert

from .readers import headed
from .shared import scratch  # noqa: F401


def csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).option("header", True).option("emptyValue", "").csv(path)


def dictionary(df: DataFrame, path: str) -> None:
    """A dictionary in ranking order: at most 65,000 rows, so one file."""
    out = df.orderBy("ranking").select(F.col("ranking").alias("Ranking"), F.col("token").alias("Token"), F.col("word").alias("Palabra"), F.col("frequency").alias("Frecuencia"))
    csv(out.coalesce(1), path)


def json_manifest(df: DataFrame, path: str) -> None:
    """JSON lines; refuses to write where something is."""
    df.write.mode("errorifexists").json(path)


def dump(df: DataFrame, path: str) -> None:
    """Pages (id, title, ns, redirect, wikitext) as an XML dump."""
    page = df.select(
        "title", "ns", "id", F.when(F.col("redirect"), F.struct(F.lit("target").alias("_title"))).alias("redirect"),
        F.struct(F.struct(F.col("wikitext").alias("_VALUE"), F.lit("preserve").alias("_space")).alias("text")).alias("revision"),
    )
    page.write.format("xml").option("rootTag", "mediawiki").option("rowTag", "page").mode("errorifexists").save(path)


def texts(df: DataFrame, path: str, *keys: str) -> None:
    """One Parquet row a document, not a file each: small files don't scale."""
    df.select(*keys, "text").write.mode("errorifexists").parquet(path)


def upsert_csv(spark: SparkSession, new: DataFrame, old_path: str | None, new_path: str, key: tuple[str, ...] = KEY) -> str:
    """Writes old rows with new ones put in to new_path (never over what is read); returns UPDATED or INSERTED."""
    if old_path is None:
        csv(new, new_path)
        return "INSERTED"
    old = headed(spark, old_path)
    old = old.select(*[F.col(c).cast(t).alias(c) if c in old.columns else F.raise_error(F.lit(f"missing {c}")).alias(c) for c, t in new.dtypes])
    found = not old.join(new.select(*key), list(key), "left_semi").isEmpty()
    csv(upsert(old, new, key), new_path)
    return "UPDATED" if found else "INSERTED"
