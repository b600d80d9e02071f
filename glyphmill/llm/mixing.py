"""Mixing sources to target weights by entropy balancing.

The mix is the one of least relative entropy to the corpus, over document rates of at most `most_copies`, whose tokens by
source meet the sources' targets exactly and whose other moments (sums over tokens of any number a document has, such as
its log length or whether it is in some language) come near theirs: their multipliers are held back by a ridge, so that
moments that the targets or the bound on rates rule out are met as far as they can be.

The entropy is that of rates between 0 and the bound, so the dual is smooth and convex, with a multiplier a source and one a
moment: a document's rate is in proportion to exp(its source's multiplier + the moments' multipliers times its numbers) while it is small,
and the bound less the rate to its inverse near the bound. Newton steps with a line search are taken on all of them jointly. Each
step's dual value, gradient and Hessian are aggregates over the table of documents, added up by source before they are
shuffled. The sources' block of the Hessian is diagonal and is eliminated where it lies, in the table of sources, however
many there are; what reaches the driver is the Schur complement of the moments, MOST_MOMENTS squared at most, and a dual value.
Rates are rounded to whole copies inside buckets of about `bucket_rows` documents of a source, carrying the error from
large documents to small ones; a source's first bucket begins with what the others have left over.

Null or empty texts have size 0 and are taken 0 times their size; a null source is a source of its own and sorts last;
repeated rows are documents of their own; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from .common import dropped, kept_columns, table, written

WEIGHTS, SHARE, MOST_COPIES, BUCKET_ROWS = (5.0, 2.0, 1.0), 1.5, 2, 1024
WORDS = r"[^\x20\x09-\x0D]+"
TOLERANCE, RIDGE, STEPS, LONGEST, MOST_MOMENTS = 1e-7, 0.01, 30, 3.0, 32


def sized(docs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, source and size (words) of each document."""
    return docs.select(*keys, "source", F.coalesce(F.regexp_count("text", F.lit(WORDS)), F.lit(0)).cast("long").alias("size"))


def ranked(sources: DataFrame) -> DataFrame:
    """sources with `rank`, from 0 in code point order, null last; ordered by ranges, so that no task gets all."""
    dealt = sources.repartitionByRange(F.col("source").asc_nulls_last()).withColumn("part", F.spark_partition_id())
    dealt = written(dealt, "sources")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    first = dealt.groupBy("part").count().select("part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("first"))  # a row a partition
    place = F.row_number().over(Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last()))
    return dealt.withColumn("place", place).join(first, "part").select("source", "source_size", "docs", (F.col("first") + F.col("place") - 1).alias("rank"))


def targets(sources: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST_COPIES) -> DataFrame:
    """source, rank, source_size, docs and target: `share` of all sizes by weight, no target above `most` times its source's size.

    The excess is shared again by weight among the others until none is above; each round is one aggregate.
    """
    weight = F.element_at(F.array(*map(F.lit, map(float, weights))), (F.col("rank") % len(weights) + 1).cast("int"))
    out = written(ranked(sources).withColumn("weight", weight).withColumn("cap", F.col("source_size") * float(most)), "ranked")
    level, full = 0.0, -1
    while True:
        capped = F.col("cap") <= F.col("weight") * level
        at = out.agg(
            (F.coalesce(F.sum("source_size"), F.lit(0)) * float(share)).alias("all"), F.coalesce(F.sum(F.when(capped, F.col("cap"))), F.lit(0.0)).alias("held"),
            F.coalesce(F.sum(F.when(~capped, F.col("weight"))), F.lit(0.0)).alias("open"), F.count(F.when(capped, 1)).alias("full"),
        ).first()
        if at.full == full or not at.open:
            break
        full, level = at.full, (at.all - at.held) / at.open
    return out.withColumn("target", F.least("cap", F.col("weight") * level)).select("source", "rank", "source_size", "docs", "target")


def moment_terms(n: int) -> list[tuple[int, int]]:
    return [(j, k) for j in range(n) for k in range(j, n)]


def evaluated(docs: DataFrame, state: DataFrame, beta: np.ndarray, most: float) -> DataFrame:
    """The state of each source with its part of the dual value, gradient and Hessian, from one aggregate over the documents.

    docs: place, size and x0, x1, ... of each document; state: place, target and multiplier of each source.
    """
    n = len(beta)
    tilt = sum((F.col(f"x{k}") * float(b) for k, b in enumerate(beta)), F.lit(0.0))
    rows = docs.join(state.select("place", "multiplier"), "place").withColumn("eta", F.col("multiplier") + tilt)
    part = 1 / (1 + F.exp(-F.col("eta")))
    rows = rows.withColumns({"tokens": F.col("size") * part * float(most), "bends": F.col("size") * part * (1 - part) * float(most)})
    value = F.col("size") * float(most) * (F.greatest("eta", F.lit(0.0)) + F.log1p(F.exp(-F.abs("eta"))))
    sums = [F.sum(value).alias("value"), F.sum("tokens").alias("tokens"), F.sum("bends").alias("bends")]
    sums += [F.sum(F.col("tokens") * F.col(f"x{k}")).alias(f"m{k}") for k in range(n)]
    sums += [F.sum(F.col("bends") * F.col(f"x{k}")).alias(f"b{k}") for k in range(n)]
    sums += [F.sum(F.col("bends") * F.col(f"x{j}") * F.col(f"x{k}")).alias(f"h{j}_{k}") for j, k in moment_terms(n)]
    return written(state.join(rows.groupBy("place").agg(*sums), "place"), "gradient")


def totals(found: DataFrame, n: int) -> Row:
    """The dual value, the largest miss of a target, and the moments' gradient and Hessian with the sources eliminated."""
    off = F.col("tokens") - F.col("target")
    per = lambda c: F.when(F.col("bends") > 0, c / F.col("bends")).otherwise(0.0)
    sums = [F.sum(F.col("value") - F.col("multiplier") * F.col("target")).alias("value"), F.max(F.abs(off) / F.col("target")).alias("off")]
    sums += [F.sum(f"m{k}").alias(f"m{k}") for k in range(n)] + [F.sum(per(F.col(f"b{k}") * off)).alias(f"r{k}") for k in range(n)]
    sums += [F.sum(F.col(f"h{j}_{k}") - per(F.col(f"b{j}") * F.col(f"b{k}"))).alias(f"h{j}_{k}") for j, k in moment_terms(n)]
    return found.agg(*sums).first()


def moved(found: DataFrame, step: np.ndarray) -> DataFrame:
    """found with `change`, the Newton step of each source's multiplier that goes with the moments' step."""
    pull = F.col("tokens") - F.col("target") + sum((F.col(f"b{k}") * float(d) for k, d in enumerate(step)), F.lit(0.0))
    return found.withColumn("change", F.when(F.col("bends") > 0, -pull / F.col("bends")).otherwise(0.0))


def balanced(docs: DataFrame, sources: DataFrame, goals: Sequence[float], most: float, ridge: float = RIDGE) -> tuple[DataFrame, np.ndarray]:
    """place and multiplier of the sources that have a target below the bound, and the moments' multipliers.

    docs: place, size, x0, x1, ...; sources: place, source_size and target; goals: what each moment's sum is to be.
    """
    n, goals = len(goals), np.array(goals, float)
    if n > MOST_MOMENTS:
        raise ValueError(f"at most {MOST_MOMENTS} moments")
    free = (F.col("target") > 0) & (F.col("target") < most * F.col("source_size") * (1 - 1e-9))
    state = written(sources.where(free).select("place", "target", F.log(F.col("target") / (most * F.col("source_size") - F.col("target"))).alias("multiplier")), "state")
    fixed = docs.join(sources.where(~free & (F.col("target") > 0)), "place").agg(*[F.coalesce(F.sum(F.col("size") * F.col(f"x{k}") * float(most)), F.lit(0.0)).alias(f"x{k}") for k in range(n)]).first() if n else ()
    whole = state.agg(F.sum("target").alias("n")).first().n
    beta = np.zeros(n)
    if not whole:
        return state, beta
    base, hold = beta, ridge * whole
    best, length, step, ahead = math.inf, 1.0, beta, None
    for turn in range(2 * STEPS):
        found = evaluated(docs, state, beta, most)
        at = totals(found, n)
        aim = goals - np.array(fixed)
        value = at.value - beta @ aim + hold / 2 * beta @ beta
        if value > best + 1e-12 * abs(best) and length > 1e-3:  # too far: half the way from where the step began
            length /= 2
        else:
            gradient = np.array([at[f"m{k}"] for k in range(n)]) - aim + hold * beta
            hessian = np.zeros((n, n))
            for j, k in moment_terms(n):
                hessian[j, k] = hessian[k, j] = at[f"h{j}_{k}"]
            late = turn >= STEPS  # moments that can't be met: their multipliers stay, the sources' follow
            if at.off < TOLERANCE and (late or np.abs(gradient).max(initial=0) < TOLERANCE * whole):
                break
            step = np.zeros(n) if late else -np.linalg.solve(hessian + hold * np.eye(n), gradient - np.array([at[f"r{k}"] for k in range(n)])) if n else step
            if ahead is not None:
                dropped(ahead)
            best, base, ahead = value, beta, written(moved(found, step).select("place", "target", "multiplier", "change"), "direction")
            length = min(1.0, LONGEST / max(ahead.agg(F.max(F.abs("change")).alias("n")).first().n, np.abs(step).max(initial=1e-9)))
        dropped(found)
        dropped(state)
        beta = base + length * step
        state = written(ahead.select("place", "target", (F.col("multiplier") + length * F.col("change")).alias("multiplier")), "state")
    return state, beta


def rounded(pdf: pd.DataFrame) -> pd.DataFrame:
    """Whole copies for the documents of a bucket: large ones first, each rounded so that the error so far, from `carried` on, is least."""
    pdf = pdf.sort_values(["size", "doc_id", "rate"], ascending=[False, True, True], kind="stable", ignore_index=True)
    size, rate = pdf["size"].to_numpy(np.int64), pdf["rate"].to_numpy(float)
    low = np.floor(rate + 1e-9)
    part = np.clip(rate - low, 0, 1)
    copies, error = low.astype(np.int64), float(pdf["carried"].iloc[0])
    for k in range(len(size)):
        error += part[k] * size[k]
        if part[k] > 1e-9 and error >= size[k] / 2:
            copies[k] += 1
            error -= size[k]
    return pdf.assign(copies=copies).drop(columns=["bucket", "carried"])


def length_moment(sizes: DataFrame) -> tuple[Column, float]:
    """The log of a document's words over its mean by tokens, whose sum is 0 in the corpus and should be in the mix."""
    log = F.log1p("size")
    mean = sizes.agg(F.try_divide(F.sum(F.col("size") * log), F.sum("size")).alias("mean")).first().mean
    return log - float(mean or 0.0), 0.0


def mixed(docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST_COPIES, bucket_rows: int = BUCKET_ROWS, keys: Sequence[str] = ("doc_id",), moments: Sequence[tuple[Column, float]] | None = None, ridge: float = RIDGE) -> DataFrame:
    """keys (doc_id among them), source, size, source_size, target, rate and copies of each document.

    moments: numbers of a document, as columns over keys, source and size, and what their sums over the mix's tokens should come
    near; if None, only that the mix keeps the corpus's mean log length by tokens, so that a source's new weight is not a
    new weight of long documents.
    """
    sizes = written(sized(kept_columns(docs, [*keys, "text", "source"]), keys), "sizes")
    wanted = [length_moment(sizes)] if moments is None else list(moments)
    sources = targets(sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("docs")), weights, share, most)
    sources = written(sources.withColumnRenamed("source", "of").withColumnRenamed("rank", "place"), "targets")
    rows = sizes.withColumns({f"x{k}": c.cast("double") for k, (c, _) in enumerate(wanted)})
    rows = written(rows.join(sources, rows["source"].eqNullSafe(sources["of"])).drop("of"), "placed")
    values = [f"x{k}" for k in range(len(wanted))]
    state, beta = balanced(rows.where("size > 0").select("place", "size", *values), sources, [t for _, t in wanted], most, ridge)
    tilt = sum((F.col(x) * float(b) for x, b in zip(values, beta, strict=True)), F.lit(0.0))
    held = F.when(F.col("target") > 0, F.lit(float(most))).otherwise(0.0)  # not in state: it takes all it may, or nothing
    rate = F.when(F.col("size") == 0, 0.0).when(F.col("multiplier").isNull(), held).otherwise(float(most) / (1 + F.exp(-F.col("multiplier") - tilt)))
    rows = rows.join(state.select("place", "multiplier"), "place", "left").withColumn("rate", F.round(rate, 9)).drop("place", "multiplier", *values)
    buckets = F.ceil(F.col("docs") / float(bucket_rows)).cast("long")
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64(*keys, "size"), buckets)).drop("docs")
    kinds = ", ".join([f"`{n}` {t}" for n, t in rows.dtypes if n != "bucket"] + ["copies long"])
    rest = rows.where("bucket > 0").withColumn("carried", F.lit(0.0)).groupBy("source", "bucket").applyInPandas(rounded, kinds)
    rest = written(rest, "rounded")
    left = rest.groupBy(F.col("source").alias("of")).agg(F.sum(F.col("size") * (F.col("rate") - F.col("copies"))).alias("carried"))
    first = rows.where("bucket = 0").join(left, F.col("source").eqNullSafe(F.col("of")), "left").drop("of").withColumn("carried", F.coalesce("carried", F.lit(0.0)))
    return rest.unionByName(first.groupBy("source", "bucket").applyInPandas(rounded, kinds))


def copied(docs: DataFrame, **how: object) -> DataFrame:
    """docs as the mix takes them: a row a copy, numbered from 1 in column copy; a column copy of its own is replaced.

    Rows equal in doc_id, text and source have the copies of as many documents dealt out among them.
    """
    names = [n for n in docs.columns if n != "copy"]
    # the row is one column, so that its names meet none of those used here
    rows = docs.select(F.struct(*[f"`{n}`" for n in names]).alias("row"), "doc_id", "text", "source").withColumn("hash", F.xxhash64("text"))
    taken = mixed(rows, keys=("doc_id", "hash"), **how).groupBy(F.col("doc_id").alias("id"), F.col("hash").alias("of"), F.col("source").alias("from")).agg(F.collect_list("copies").alias("each"))
    taken = written(taken.where(F.exists("each", lambda n: n > 0)), "taken")
    rows = rows.drop("text")
    same = F.col("doc_id").eqNullSafe(F.col("id")) & F.col("hash").eqNullSafe(F.col("of")) & F.col("source").eqNullSafe(F.col("from"))
    one = rows.join(taken.where(F.size("each") == 1), same).withColumn("copies", F.col("each")[0])
    place = F.row_number().over(Window.partitionBy("id", "of", "from").orderBy(F.lit(1)))
    more = rows.join(taken.where(F.size("each") > 1), same).withColumn("copies", F.element_at("each", place)).where("copies > 0")
    return one.unionByName(more).select(*[F.col(f"row.`{n}`").alias(n) for n in names], F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def mixing_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can tell of op3_mixing's columns: sizes, targets, and that no document is taken more than twice."""
    rows = op3_mixing(spark, sf_dir)
    whole = F.col("taken") == F.when(F.col("size") > 0, F.col("size") * F.round(F.try_divide(F.col("taken"), F.col("size")))).otherwise(0)
    return rows.select("doc_id", "size", "source_size", F.round("target", 3).alias("target"), (whole & (F.col("taken") <= 2 * F.col("size"))).alias("whole"))


TARGETS_SQL = r"""
with d as (select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size from documents),
s as (select source, sum(size)::bigint as source_size, row_number() over (order by source nulls last) - 1 as k from d group by source),
c as (select *, case k % 3 when 0 then 5.0 when 1 then 2.0 else 1.0 end as w, 2.0 * source_size as cap, 1.5 * sum(source_size) over () as whole from s),
o as (select *, cap / w as q, (whole - coalesce(sum(cap) over (order by cap / w, k rows between unbounded preceding and 1 preceding), 0)) / sum(w) over (order by cap / w, k rows between current row and unbounded following) as level from c),
l as (select min(level) as level from (select level, q from o where q > level order by q, k limit 1))
select doc_id, size, source_size, round(least(cap, w * coalesce((select level from l), 1e300))::double, 3) as target, true as whole from d join o on d.source is not distinct from o.source
"""
