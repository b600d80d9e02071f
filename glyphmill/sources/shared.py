"""The folder that driver and executors share, and tables kept there."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch(spark: SparkSession, tag: str) -> str:
    """A fresh path below spark.checkpoint.dir, which driver and executors share; where that is unset, a temporary one, on one machine only."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        at = "file://" + tempfile.mkdtemp(prefix="glyphmill-")
    return f"{at.rstrip('/')}/{tag}-{uuid.uuid4().hex}"


def kept(df: DataFrame, tag: str) -> DataFrame:
    """df, written to the shared folder and read again: what is above it runs once, however often it is used."""
    at = scratch(df.sparkSession, tag)
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)
