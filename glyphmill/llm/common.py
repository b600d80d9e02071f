"""What several operators of this subpackage share: the shared folder, written tables, Arrow slices."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one numpy pass takes at a time; a longer single text is a pass of its own.
SLICE_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which driver and executors share; where it is unset, a temporary one, on one machine only."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        at = "file://" + tempfile.mkdtemp(prefix="glyphmill-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def scratch(spark: SparkSession, tag: str) -> str:
    """A fresh path below the shared folder, as a URI."""
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def written(df: DataFrame, tag: str) -> DataFrame:
    """df, written as Parquet to the shared folder and read again: cuts lineage, and runs what is above it once."""
    spark, at = df.sparkSession, scratch(df.sparkSession, tag)
    df.write.parquet(at)
    out = spark.read.schema(df.schema).parquet(at)
    out._glyphmill_path = at
    return out


def dropped(df: DataFrame) -> None:
    """Removes the files behind a written() table that nothing reads any more."""
    if at := getattr(df, "_glyphmill_path", None):
        removed(df.sparkSession, at)


def removed(spark: SparkSession, at: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: A key is salted if it has more than one of so many rows, so there are at most so many such keys.
HOT_SHARE, SALTS = 1000, 64


def matched(rows: DataFrame, keyed: DataFrame, on: list[str], by: str, how: str = "left") -> DataFrame:
    """rows joined with keyed, which has one row for each key `on` and its number of rows in column times; times is dropped.

    The rows of a key that more than 1 / HOT_SHARE of all rows have are dealt out by a hash of column `by` into SALTS parts.
    """
    hot = F.col("times") * HOT_SHARE > F.lit(keyed.agg(F.sum("times").alias("n")).first().n or 0)
    salted = keyed.select(*on, *[c for c in keyed.columns if c not in (*on, "times")], F.explode(F.when(hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))).alias("salt"))
    few = F.broadcast(keyed.where(hot).select(*on, F.lit(True).alias("salted")))  # HOT_SHARE rows at most, as they have 1 / HOT_SHARE of all each
    dealt = rows.join(few, on, "left").withColumn("salt", F.when(F.col("salted"), F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int")).otherwise(0)).drop("salted")
    return dealt.join(salted, [*on, "salt"], how).drop("salt")


#: Bits of a sieve: what reaches the driver and the tasks is 8 MB at most, however many keys there are.
SIEVE_BITS = 26


class Sieve:
    """A test of 64-bit hashes, as an array or (called) a column: false only for values that the keys don't have, and mostly for those.

    Rows that fail it need no join with the keys. With far more keys than bits all rows pass it.
    """

    def __init__(self, sent):
        self.sent = sent

    def has(self, values: np.ndarray) -> np.ndarray:
        place = values.astype(np.int64, copy=False) & ((1 << SIEVE_BITS) - 1)
        return (np.frombuffer(self.sent.value, np.uint8)[place >> 3] >> (place & 7).astype(np.uint8) & 1).astype(bool)

    def __call__(self, column: str | Column) -> Column:
        own = self

        @F.pandas_udf("boolean")
        def test(values: pd.Series) -> pd.Series:
            return pd.Series(own.has(values.to_numpy()))

        return test(column)


def sieve(keys: DataFrame, column: str) -> Sieve:
    spark, bucket = keys.sparkSession, 1 << 15
    at = F.pmod(F.col(column), F.lit(1 << SIEVE_BITS))
    rows = keys.select(F.floor(at / bucket).cast("int").alias("bucket"), (at % bucket).alias("bit")).groupBy("bucket").agg(F.bitmap_construct_agg("bit").alias("bits"))
    bits = np.zeros((1 << SIEVE_BITS) // bucket, f"V{bucket // 8}")
    for row in rows.collect():  # as many rows as buckets at most, of 4 KB each
        bits[row.bucket] = np.frombuffer(bytes(row.bits), bits.dtype)[0]
    return Sieve(spark.sparkContext.broadcast(bits.tobytes()))


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """The Arrow file system of a URI (file, s3, gs, hdfs) and the path in it; for tasks that read or write ranges of bytes."""
    return pafs.FileSystem.from_uri(uri if "://" in uri else "file://" + uri.removeprefix("file:"))


def utf8(column: pa.Array) -> pa.Array:
    """A string or binary column as string values with 32-bit offsets, null as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.cast(pa.binary()).fill_null(b"")


def slices(batch: pa.RecordBatch, name: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of a batch in runs whose texts hold `most` bytes together, or one row if it alone is longer."""
    if not batch.num_rows:
        return
    ends = np.cumsum(lengths(utf8(batch.column(batch.schema.get_field_index(name)))))
    at, base = 0, 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(ends, base + most, "right")))
        yield batch.slice(at, to - at)
        at, base = to, int(ends[to - 1])


def lengths(column: pa.Array) -> np.ndarray:
    return np.diff(offsets(column))


def offsets(column: pa.Array) -> np.ndarray:
    """Offsets of a binary column's values in its data buffer."""
    return np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)


def joined(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a binary column end to end, and the offsets of its values in them."""
    off = offsets(column)
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None and off[-1] > off[0] else np.zeros(0, np.uint8)
    return raw, off - off[0]


def kept_columns(df: DataFrame, names: list[str]) -> DataFrame:
    """Only the columns an operator reads, so that extra ones can't clash with its own."""
    return df.select(*[F.col(f"`{n}`") for n in names])
