"""Readers: dictionaries, dumps, manifests, selections, checkpoints, texts and PDF files."""

from __future__ import annotations

import io

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphmill.functions.text import base_name, strip, unix_newlines

# Column names of the formats.
DICTIONARY_COLUMNS = "Ranking INT, Token INT, Palabra STRING, Frecuencia BIGINT"
PAGE = "title STRING, ns STRING, id STRING, redirect STRUCT<_title: STRING>, revision STRUCT<text: STRUCT<_VALUE: STRING>>"
MANIFEST = "selection_order INT, valid_article_order INT, identifier STRING, source_code STRING, page_id STRING, title STRING, snapshot_date STRING, segment STRING, source_url STRING, original_wikitext_characters INT, cleaned_characters INT, removed_characters INT, reduction_ratio DOUBLE, local_path STRING, evaluation_role STRING, selection_skip INT, selection_target INT, acquisition_status STRING"
# End of the fixed values.


#: Bytes of input a core below which rows are dealt out: a small file can be one row group, which one task would read alone.
SPREAD_BYTES = 16 << 20


def spread(df: DataFrame) -> DataFrame:
    """A small table, its rows dealt out to all cores; a large one as it is, as it has splits enough."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    return df.repartition(cores) if int(size) < cores * SPREAD_BYTES else df


def headed(spark: SparkSession, path: str) -> DataFrame:
    """A CSV file with a header, all columns as strings; a byte order mark is passed over."""
    return spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("encoding", "UTF-8").csv(path)


def dictionary(spark: SparkSession, path: str) -> DataFrame:
    """ranking, token, word and frequency (null where blank or absent) of a dictionary file."""
    rows = headed(spark, path)
    missing = {"Ranking", "Token", "Palabra"} - set(rows.columns)
    if missing:
        raise ValueError(f"missing columns: {', '.join(sorted(missing))}")
    count = strip(F.col("Frecuencia")) if "Frecuencia" in rows.columns else F.lit(None).cast("string")
    return rows.select(strip(F.col("Ranking")).cast("int").alias("ranking"), strip(F.col("Token")).cast("int").alias("token"), strip(F.col("Palabra")).alias("word"), F.nullif(count, F.lit("")).cast("long").alias("frequency"))


def dictionary_files(spark: SparkSession, folder: str, prefix: str) -> DataFrame:
    """path, name and requested size of the files <prefix>_<size>_<name>.csv of a folder; others are passed over."""
    pattern = rf"(?i)^{prefix}_(\d+)_(.+)\.csv$"
    rows = spark.read.format("binaryFile").option("pathGlobFilter", "*.csv").load(folder).select("path", base_name(F.col("path")).alias("name"))
    return rows.where(F.col("name").rlike(pattern)).withColumn("requested", F.regexp_extract("name", pattern, 1).cast("int"))


def dump(spark: SparkSession, path: str) -> DataFrame:
    """id, title, ns, redirect and wikitext of the pages of an XML dump, compressed or not."""
    rows = spark.read.format("xml").option("rowTag", "page").option("ignoreSurroundingSpaces", False).option("ignoreNamespace", True).schema(PAGE).load(path)
    return rows.select(strip(F.col("id")).alias("id"), "title", "ns", F.col("redirect").isNotNull().alias("redirect"), F.coalesce("revision.text._VALUE", F.lit("")).alias("wikitext"))


def json_manifest(spark: SparkSession, path: str, schema: str = MANIFEST) -> DataFrame:
    """A JSON-lines manifest; blank lines are passed over, a broken line fails the job."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def extraction_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a CSV manifest that were extracted, with CandidateOrder as a number, in its order."""
    rows = headed(spark, path).where(F.upper(strip(F.col("ExtractionStatus"))) == "EXTRACTED")
    return rows.withColumn("CandidateOrder", F.col("CandidateOrder").cast("int")).orderBy("CandidateOrder")


def selected(spark: SparkSession, path: str) -> DataFrame:
    rows = headed(spark, path).where(F.upper(strip(F.col("Selected"))) == "YES")
    return rows.withColumn("CandidateOrder", F.col("CandidateOrder").cast("int")).orderBy("CandidateOrder")


def checkpoint(spark: SparkSession, path: str) -> DataFrame:
    """A resumable run's manifest: the last row of each CandidateOrder counts, rows without a number don't."""
    rows = headed(spark, path)
    number = F.expr("try_cast(CandidateOrder as int)")
    rows = rows.withColumn("_at", F.monotonically_increasing_id()).withColumn("CandidateOrder", number).where("CandidateOrder is not null")
    last = rows.groupBy("CandidateOrder").agg(F.max("_at").alias("_at"))
    return rows.join(last, ["CandidateOrder", "_at"]).drop("_at")


def texts(spark: SparkSession, path: str) -> DataFrame:
    """path and text of whole files, line ends as LF."""
    rows = spark.read.text(path, wholetext=True)
    return rows.select(F.col("_metadata.file_path").alias("path"), unix_newlines(F.col("value")).alias("text"))


def raw_texts(spark: SparkSession, path: str) -> DataFrame:
    """path, bytes and text of whole files as they are."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return rows.select("path", F.col("length").alias("bytes"), F.decode("content", "UTF-8").alias("text"))


def checked_texts(manifest: DataFrame, found: DataFrame, path: str, size: str) -> DataFrame:
    """manifest with text and status: OK, FILE_NOT_FOUND, or SIZE_DIFFERS where raw_texts() has other bytes than it says."""
    rows = manifest.join(found.select(F.col("path").alias("found_path"), F.col("bytes").alias("found_bytes"), "text"), F.col(path) == F.col("found_path"), "left")
    status = F.when(F.col("found_path").isNull(), "FILE_NOT_FOUND").when(F.col("found_bytes") != F.col(size), "SIZE_DIFFERS").otherwise("OK")
    return rows.withColumn("status", status).drop("found_path", "found_bytes")


def pdf_files(spark: SparkSession, folder: str) -> DataFrame:
    """path, length and content of all PDF files below a folder."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.[pP][dD][fF]").load(folder)
    return rows.select("path", "length", "content")


def pdf_text(files: DataFrame, keep_empty_pages: bool = False) -> DataFrame:
    """files with text, pages, pages_with_text, status (EXTRACTED, NO_TEXT or ERROR) and error; needs the package pypdf.

    Pages are joined by line ends; empty ones are passed over unless they are kept.
    """

    @F.pandas_udf("text string, pages int, pages_with_text int, error string")
    def extract(contents: pd.Series) -> pd.DataFrame:
        from pypdf import PdfReader

        rows = []
        for content in contents:
            try:
                found = [page.extract_text() or "" for page in PdfReader(io.BytesIO(content), strict=False).pages]
                kept = found if keep_empty_pages else [p for p in found if p.strip()]
                rows.append(("\n".join(kept), len(found), sum(bool(p.strip()) for p in found), None))
            except Exception as e:  # noqa: BLE001 - one file's failure is a row's status
                rows.append((None, 0, 0, str(e)[:500]))
        return pd.DataFrame(rows, columns=["text", "pages", "pages_with_text", "error"])

    out = files.withColumn("found", extract("content")).select("*", "found.*").drop("found")
    status = F.when(F.col("error").isNotNull(), "ERROR").when(strip(F.col("text")) == "", "NO_TEXT").otherwise("EXTRACTED")
    return out.withColumn("status", status)
