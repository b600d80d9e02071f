"""A training corpus from documents: five filtering and rewriting stages, each over all that the one before it kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last keep the columns of documents. run()
writes each stage's result to the shared folder and reads it again, so a lost executor costs one stage at most.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphmill.llm import decontamination, mixing, pii, simhash, toxicity
from glyphmill.llm.common import table, written

#: No SQL can express a fitted classifier or keyed pseudonyms; tests hold run() against brute force.
ORACLE_SQL = None


def aside(docs: DataFrame) -> DataFrame:
    """doc_id and text, and the rest of the row as one column, so that its names meet none that an operator adds."""
    return docs.select(F.struct(*[f"`{n}`" for n in docs.columns if n != "text"]).alias("row"), "doc_id", "text")


def rows(out: DataFrame, docs: DataFrame, **new: Column) -> DataFrame:
    """The columns of docs from aside() rows, but for the text and the new ones."""
    return out.select(*[(new[n] if n in new else F.col("text") if n == "text" else F.col(f"row.`{n}`")).alias(n) for n in docs.columns])


def toxic_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on these documents and the labels outside its held-out fold, doesn't call toxic.

    A null or empty text scores by the model's intercept; without documents or positive labels all are kept.
    """
    model = toxicity.trained(docs, table(spark, sf_dir, "labels"))
    return rows(toxicity.scored(aside(docs), model).where("score < 0.5"), docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: five-word shingles, similarity 0.8. Texts without words are one group."""
    return simhash.deduplicated(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of ten consecutive words of a benchmark item occurs; all if the benchmark is empty."""
    return rows(decontamination.marked(aside(docs), table(spark, sf_dir, "benchmark")).where("n_hit = 0"), docs)


def pseudonymised(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with pseudonyms in text (by the session's key), and n_chars as it then is; null texts stay null."""
    out = pii.replaced(aside(docs), pii.session_key(spark))
    changed = sum((F.col(f"n_{k}") for k in pii.KINDS), F.lit(0)) > 0
    return rows(out, docs, n_chars=F.when(changed, F.char_length("text").cast("long")).otherwise(F.col("row.n_chars")))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: a row for each copy taken of a document, numbered in copy; a null source is one of its own."""
    return mixing.copied(docs)


STAGES = [("toxicity", toxic_out), ("near_dedup", near_dedup), ("decontamination", decontaminated), ("pii", pseudonymised), ("mixing", mixed)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
