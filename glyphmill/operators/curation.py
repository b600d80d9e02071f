"""Corpus curation: funnels, exact and normalized dedup, selections, manifests and resuming."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glyphmill.functions.text import base_name, family_key, strip, text_sha256, work_id
from glyphmill.sources.shared import kept

from .wikitext import clean


def article_stage(pages: DataFrame) -> DataFrame:
    """pages (id, title, ns, redirect, wikitext) with stage, the first test failed or ACCEPTED, and cleaned.

    Cleaning runs only for pages that pass the cheap tests before it.
    """
    cheap = (
        F.when(F.coalesce(F.col("ns"), F.lit("")) != "0", "OTHER_NAMESPACE").when(F.col("redirect"), "REDIRECT")
        .when(strip(F.coalesce(F.col("wikitext"), F.lit(""))) == "", "NO_WIKITEXT")
    )
    rows = pages.withColumn("cheap", cheap)
    rest = rows.where("cheap is null").withColumn("cleaned", clean(F.col("wikitext")))
    late = F.when(strip(F.col("cleaned.text")) == "", "EMPTY_AFTER_CLEANING").when(strip(F.coalesce(F.col("id"), F.lit(""))) == "", "NO_ID").otherwise("ACCEPTED")
    done = rest.withColumn("stage", late)
    out = rows.where("cheap is not null").withColumn("cleaned", F.lit(None).cast(done.schema["cleaned"].dataType)).withColumn("stage", F.col("cheap"))
    return done.unionByName(out).drop("cheap")


def funnel(rows: DataFrame, stage: str = "stage") -> DataFrame:
    return rows.groupBy(F.col(stage).alias("stage")).agg(F.count(F.lit(1)).alias("n"))


def skip_take(rows: DataFrame, skip: int, take: int, *order: str | Column) -> DataFrame:
    """`take` rows after the first `skip` in order, numbered from 1 in selection_order."""
    kept = rows.orderBy(*order).offset(skip).limit(take)
    return kept.withColumn("selection_order", F.row_number().over(Window.orderBy(*order)))


def require_count(rows: DataFrame, wanted: int) -> DataFrame:
    """rows, if there are so many; an error else."""
    found = rows.count()
    if found != wanted:
        raise ValueError(f"wanted {wanted} rows, found {found}")
    return rows


def deduplicate(files: DataFrame, path: str, digest: Column, status: str) -> DataFrame:
    """files with duplicate_of (the first path, case folded, of equal digest) and `status` for all but that one.

    The first path of a digest is an aggregate, joined back, so that a digest of many files needs no window. Rows that repeat
    path and digest are one file listed twice: they get the same result. A null digest has no duplicates.
    """
    rows = files.withColumn("_digest", digest)
    order = F.struct(F.lower(path).alias("folded"), F.col(path).alias("path"))
    first = rows.where("_digest is not null").groupBy("_digest").agg(F.min(order)["path"].alias("_first"))
    rows = rows.join(first, "_digest", "left")
    again = F.col(path) != F.col("_first")
    return rows.withColumn("duplicate_of", F.when(again, F.col("_first"))).withColumn("status", F.when(again, status)).drop("_digest", "_first")


def dataset_manifest(files: DataFrame, path: str, content: str, text: Column) -> DataFrame:
    """Two-level dedup: by bytes, then by normalized text of what is unique by bytes.

    status: BINARY_DUPLICATE, NO_TEXT, TEXT_DUPLICATE or EXTRACTED. Digests and sizes are made of all files in one scan and
    kept in the shared folder; only those narrow rows are joined and shuffled.
    """
    has = F.coalesce(strip(text) != "", F.lit(False))
    made = {"binary_sha256": F.sha2(F.col(content), 256), "text_sha256": F.when(has, text_sha256(text)), "extracted_characters": F.coalesce(F.char_length(text), F.lit(0)), "extracted_utf8_bytes": F.coalesce(F.octet_length(text), F.lit(0))}
    narrow = kept(files.withColumns(made).drop(content), "manifest")
    level1 = deduplicate(narrow, path, F.col("binary_sha256"), "BINARY_DUPLICATE").withColumnsRenamed({"status": "_status", "duplicate_of": "_duplicate_of"})
    # the second level is that of files that are first by bytes; others keep no text
    own = F.when(F.col("_status").isNull(), F.col("text_sha256"))
    level2 = deduplicate(level1, path, own, "TEXT_DUPLICATE")
    first = F.col("_status").isNull()
    status = F.coalesce("_status", "status", F.when(F.col("text_sha256").isNull(), "NO_TEXT").otherwise("EXTRACTED"))
    out = level2.withColumns({"status": status, "duplicate_of": F.coalesce("_duplicate_of", "duplicate_of")})
    return out.withColumns({c: F.when(first, F.col(c)) for c in ("text_sha256", "extracted_characters", "extracted_utf8_bytes")}).drop("_status", "_duplicate_of")


def status_counts(manifest: DataFrame) -> DataFrame:
    return manifest.groupBy("status").agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("extracted_utf8_bytes"), F.lit(0)).alias("utf8_bytes"))


def members(rows: DataFrame, key: str, path: str) -> DataFrame:
    """key, copies and path of the rows whose key several rows have: a row a path, so that a key of any number of files fits."""
    counts = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")
    return rows.select(key, path).join(counts, key).select(key, "copies", path)


def group_by_digest(rows: DataFrame, digest: str, path: str) -> DataFrame:
    """digest, copies and path of digests that several rows have."""
    return members(rows, digest, path)


def families(selection: DataFrame, path: str) -> DataFrame:
    """family_key, copies and path of works that seem to be there several times."""
    return members(selection.withColumn("family_key", family_key(F.col(path))), "family_key", path)


# Columns of the manifest and selection formats, and what they say of what was left out.
MANIFEST_COLUMNS = ("Specialty", "RelativePath", "FileSizeBytes", "BinarySHA256", "ExtractedCharacters", "ExtractedUTF8Bytes", "TextSHA256", "ExtractionStatus", "DuplicateOf", "ExtractionError")
SELECTION_COLUMNS = ("Specialty", "CandidateOrder", "WorkID", "RelativePath", "WorkPart", "Selected", "SelectionReason", "ExtractedCharacters", "ExtractedUTF8Bytes", "BinarySHA256", "TextSHA256", "Notes")
SELECTED, SAME_WORK = "SELECTED", "SAME_WORK_ALTERNATIVE"
EXCLUDED_NOTE = "Excluded during work-level curation; another representation of the same or potentially duplicated intellectual work was retained."
# End of the fixed values.


def manifest_rows(manifest: DataFrame, specialty: Column, path: str, size: Column, error: Column | None = None) -> DataFrame:
    """dataset_manifest() in the columns of the manifest format; a missing text has 0 characters, other blanks are empty."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    number = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    values = (specialty, F.col(path), size, blank("binary_sha256"), number("extracted_characters"), number("extracted_utf8_bytes"), blank("text_sha256"), F.col("status"), blank("duplicate_of"), F.lit("") if error is None else F.coalesce(error, F.lit("")))
    return manifest.select(*[v.alias(n) for v, n in zip(values, MANIFEST_COLUMNS, strict=True)])


def selection(manifest: DataFrame, order: str, path: str, specialty: Column, excluded: Sequence[int] = (), reason: str = SAME_WORK) -> DataFrame:
    """candidate_order, work_id, path, selected (YES or NO), selection_reason and notes of the EXTRACTED rows, in manifest order."""
    place = numbered(manifest.where("status = 'EXTRACTED'"), order).withColumnRenamed("n", "candidate_order")
    out = F.col("candidate_order").isin(*excluded) if excluded else F.lit(False)
    return place.withColumns({
        "work_id": work_id(specialty, F.col("candidate_order"), F.col(path)), "selected": F.when(out, "NO").otherwise("YES"),
        "selection_reason": F.when(out, reason).otherwise(SELECTED), "notes": F.when(out, EXCLUDED_NOTE).otherwise(""),
    })


def selection_rows(manifest: DataFrame, order: str, excluded: Sequence[int] = (), reason: str = SAME_WORK) -> DataFrame:
    """selection() of rows in the manifest format and a column `order`, in the columns of the selection format."""
    rows = selection(manifest.withColumn("status", F.col("ExtractionStatus")), order, "RelativePath", F.col("Specialty"), excluded, reason)
    own = {"CandidateOrder": "candidate_order", "WorkID": "work_id", "Selected": "selected", "SelectionReason": "selection_reason", "Notes": "notes"}
    return rows.select(*[(F.lit(1) if n == "WorkPart" else F.col(own.get(n, n))).alias(n) for n in SELECTION_COLUMNS])


def numbered(rows: DataFrame, order: str) -> DataFrame:
    """rows with n: their number from 1 in the order of a column; equal ones in any order, nulls last.

    Row numbers within ranges of about as many rows (by approximate quantiles, a few hundred numbers at the driver), plus the
    counts of the ranges before: the only window without a key is over those.
    """
    cuts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    edges = rows.agg(F.percentile_approx(order, [k / cuts for k in range(1, cuts)] or [0.5], 1000).alias("edges")).first().edges or []
    place = F.when(F.col(order).isNull(), len(edges) + 1).otherwise(sum((F.when(F.col(order) > F.lit(e), 1).otherwise(0) for e in edges), F.lit(0)))
    ranged = rows.withColumn("_range", place)
    before = ranged.groupBy("_range").count().withColumn("_before", F.coalesce(F.sum("count").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("count")
    own = F.row_number().over(Window.partitionBy("_range").orderBy(F.col(order).asc_nulls_last()))
    return ranged.withColumn("_own", own).join(before, "_range").withColumn("n", (F.col("_own") + F.col("_before")).cast("int")).drop("_range", "_own", "_before")


def invalid_exclusions(manifest: DataFrame, order: str, excluded: DataFrame) -> DataFrame:
    """Excluded orders that no EXTRACTED row has."""
    return excluded.select(order).distinct().join(manifest.where("status = 'EXTRACTED'").select(order), order, "left_anti")


def pending(selected: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows still to be processed when a run is resumed."""
    return selected.join(done.select(key), key, "left_anti")


def latest(checkpoint: DataFrame, key: str, written: str) -> DataFrame:
    """The last row written for each key; rows whose key is no number are passed over."""
    ok = checkpoint.where(F.expr(f"try_cast(`{key}` as int)").isNotNull())
    return ok.groupBy(F.col(key).cast("int").alias(key)).agg(F.max_by(F.struct(*[c for c in ok.columns if c != key]), F.col(written)).alias("row")).select(key, "row.*")


def file_problems(manifest: DataFrame, listing: DataFrame, order: str, path: str, digest: str, wanted: int | None = None) -> DataFrame:
    """One row: rows, and whether there are `wanted` of them, all have a digest and a listed file, and no order is there twice."""
    there = listing.select(F.col("path").alias("listed_path")).distinct()
    rows = manifest.select(F.col(order).alias("order"), F.col(path).alias("path"), F.col(digest).alias("digest")).join(there, F.col("path") == F.col("listed_path"), "left")
    n = F.count(F.lit(1))
    return rows.agg(
        n.alias("rows"), (n == wanted if wanted is not None else F.lit(True)).alias("count_ok"), (F.count_if(F.coalesce(strip(F.col("digest")), F.lit("")) == "") == 0).alias("digests_ok"),
        (F.count("listed_path") == n).alias("files_ok"), (F.count_distinct("order") == n).alias("orders_ok"),
    )


def manifest_problems(manifest: DataFrame, order: str = "selection_order", page: str = "page_id", single: Sequence[str] = ("snapshot_date", "segment", "evaluation_role")) -> DataFrame:
    """One row: rows, and whether orders run from 1 without gap, pages are distinct, and metadata has one value at most."""
    value = lambda c: F.when(strip(F.col(c).cast("string")) != "", F.col(c))
    return manifest.agg(
        F.count(F.lit(1)).alias("rows"),
        ((F.min(order) == 1) & (F.max(order) == F.count(F.lit(1))) & (F.count_distinct(order) == F.count(F.lit(1)))).alias("orders_ok"),
        (F.count_distinct(page) == F.count(F.lit(1))).alias("pages_ok"),
        *[(F.count_distinct(value(c)) <= 1).alias(f"{c}_ok") for c in single],
    )


def resolved_paths(manifest: DataFrame, listing: DataFrame, path: str, root: str, domain: str) -> DataFrame:
    """manifest with resolved: the first of the path itself, below root, below domain, and in extracted_text that is listed."""
    tries = [F.col(path), F.concat(F.lit(root.rstrip("/") + "/"), F.col(path)), F.concat(F.lit(domain.rstrip("/") + "/"), F.col(path)), F.concat(F.lit(domain.rstrip("/") + "/extracted_text/"), base_name(F.col(path)))]
    rows = manifest
    for k, candidate in enumerate(tries):
        found = listing.select(F.col("path").alias(f"_found{k}"))
        rows = rows.join(found, candidate == F.col(f"_found{k}"), "left")
    return rows.withColumn("resolved", F.coalesce(*[F.col(f"_found{k}") for k in range(len(tries))])).drop(*[f"_found{k}" for k in range(len(tries))])
