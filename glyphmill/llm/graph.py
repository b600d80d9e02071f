"""Connected components of a table of links, by alternating large-star and small-star steps.

Each step's least neighbours are written before they are joined, so that a hub's links can be split among tasks; nothing
reaches the driver but a count and a checksum a round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, written


def star(links: DataFrame, least: DataFrame) -> DataFrame:
    """links (u, v) with m, the least neighbour of u. A row with u = v stands for u itself."""
    least = written(least, "least")
    out = links.join(least, "u")
    out._least = least
    return out


def large(links: DataFrame) -> DataFrame:
    both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    out = star(both.where("v > u"), both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))
    return step(out.select(F.col("v").alias("u"), F.col("m").alias("v")), out._least)


def small(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v")
    out = star(down, down.groupBy("u").agg(F.min("v").alias("m")))
    rest = out.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return step(rest.union(out._least.select("u", F.col("m").alias("v"))), out._least)


def step(links: DataFrame, least: DataFrame) -> DataFrame:
    out = written(links.where("u <> v").distinct(), "links")
    dropped(least)
    return out


def components(links: DataFrame) -> DataFrame:
    """node and root, the least node reachable, for all nodes of links (u, v) of one orderable type; loops are passed over."""
    now, mark = written(links.where("u <> v").distinct(), "links"), None
    while True:
        first = large(now)
        dropped(now)
        now = small(first)
        dropped(first)
        seen = now.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("sum")).first()
        if seen == mark or not seen.n:
            break
        mark = seen
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select(F.col("v"), F.col("v")).distinct())
