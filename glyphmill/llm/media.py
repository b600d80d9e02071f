"""Media columns: payloads in tar shards, addressed by content; rows carry digest, offset and length.

Each write task packs its payloads into shards below a shared folder, as grey 8-bit PNG images 64 samples wide, once
for each digest and shard; the index then takes one place a digest, the least, and all rows of the digest name it. (Copies of a
payload that other tasks have written are not named by any row; finding them before they are written would mean to shuffle texts.) A shard is named after its task attempt,
so a task that runs again writes files of its own, and rows only name files of tasks that were committed. Texts never
cross the network: only index rows are shuffled. Metadata columns come from range reads of the PNG header alone.

A null or empty text has n_bytes 0 and a payload of 64 zero bytes. Equal texts share a place; repeated rows each keep
their row. An empty table writes nothing and gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import math
import struct
import tarfile
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import filesystem, kept_columns, matched, scratch, table, utf8, written

WIDTH, SHARD_BYTES, HEADER_BYTES, TASK_BYTES = 64, 256 << 20, 33, 8 << 20
SIGNATURE = b"\x89PNG\r\n\x1a\n"


def payload(text: bytes) -> bytes:
    """text and zero bytes up to a positive multiple of 64."""
    return text.ljust(max(1, -(-len(text) // WIDTH)) * WIDTH, b"\0")


def chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def encoded(data: bytes) -> bytes:
    """A grey 8-bit PNG of the samples, WIDTH a row, unfiltered."""
    rows = np.zeros((len(data) // WIDTH, WIDTH + 1), np.uint8)
    rows[:, 1:] = np.frombuffer(data, np.uint8).reshape(-1, WIDTH)
    packed = zlib.compress(rows.tobytes(), 6)
    parts = [packed[k : k + (1 << 30)] for k in range(0, len(packed), 1 << 30)]
    return SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)) + b"".join(chunk(b"IDAT", p) for p in parts) + chunk(b"IEND", b"")


def header(stored: bytes) -> tuple[int, int, int, int]:
    """Width, height, bits a sample and colour type, from the first HEADER_BYTES."""
    if stored[:8] != SIGNATURE or stored[12:16] != b"IHDR":
        raise ValueError("not a PNG")
    return struct.unpack(">IIBB", stored[16:26])


def decoded(stored: bytes) -> bytes:
    """The samples of an image as encoded() writes them."""
    width, height, bits, colour = header(stored)
    if (bits, colour) != (8, 0):
        raise ValueError("not 8-bit grey")
    at, parts = 8, []
    while at < len(stored):
        size, kind = struct.unpack(">I4s", stored[at : at + 8])
        if struct.unpack(">I", stored[at + 8 + size : at + 12 + size])[0] != zlib.crc32(stored[at + 4 : at + 8 + size]):
            raise ValueError("chunk checksum")
        if kind == b"IDAT":
            parts.append(stored[at + 8 : at + 8 + size])
        at += 12 + size
    rows = np.frombuffer(zlib.decompress(b"".join(parts)), np.uint8).reshape(height, width + 1)
    if rows[:, 0].any():
        raise ValueError("filtered rows")
    return rows[:, 1:].tobytes()


class Shards:
    """The tar files of one task attempt."""

    def __init__(self, folder: str, most: int):
        self.fs, self.folder = filesystem(folder)
        self.uri, self.most, self.count, self.out = folder, most, 0, None
        task = TaskContext.get()
        self.stem = f"shard-{task.partitionId():06d}-{task.taskAttemptId()}" if task else "shard"

    def put(self, digest: str, make: Iterable[bytes]) -> tuple[str, int, int]:
        """Shard, offset and length of the payload with this digest, stored unless the open shard has it."""
        if self.out is None:
            self.name = f"{self.stem}-{self.count:04d}.tar"
            self.fs.create_dir(self.folder, recursive=True)
            self.out, self.at, self.have = self.fs.open_output_stream(f"{self.folder}/{self.name}"), 0, {}
            self.count += 1
        if digest not in self.have:
            data = next(iter(make))
            info = tarfile.TarInfo(f"{digest}.png")
            info.size = len(data)
            head = info.tobuf(tarfile.GNU_FORMAT)
            self.out.write(head + data + bytes(-len(data) % 512))
            self.have[digest] = (f"{self.uri}/{self.name}", self.at + len(head), len(data))
            self.at += len(head) + len(data) + -len(data) % 512
        place = self.have[digest]
        if self.at >= self.most:
            self.close()
        return place

    def close(self) -> None:
        if self.out is not None:
            self.out.write(bytes(1024))
            self.out.close()
            self.out = None


def stored(docs: DataFrame, folder: str, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """doc_id, n_bytes, payload_bytes, digest, shard, offset and length of each document, whose payloads it writes to folder."""
    kind = dict(docs.dtypes)["doc_id"]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards = Shards(folder, shard_bytes)
        for batch in batches:
            rows = []
            for text in utf8(batch.column(1)):
                raw = text.as_py()
                data = payload(raw)
                digest = hashlib.sha256(data).hexdigest()
                rows.append((len(raw), len(data), digest, *shards.put(digest, (encoded(x) for x in (data,)))))
            made = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [()] * 6, (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64()), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *made], names=["doc_id", "n_bytes", "payload_bytes", "digest", "shard", "offset", "length"])
        shards.close()

    return kept_columns(docs, ["doc_id", "text"]).mapInArrow(pack, f"doc_id {kind}, n_bytes long, payload_bytes long, digest string, shard string, offset long, length long")


def places(rows: DataFrame) -> DataFrame:
    """One place for each digest, the least of those written: digest, shard, offset, length and times (its rows); ordered for reading in runs."""
    one = rows.groupBy("digest").agg(F.min(F.struct("shard", "offset", "length")).alias("at"), F.count(F.lit(1)).alias("times")).select("digest", "at.*", "times")
    one = written(one, "places")
    work = one.agg(F.sum("length").alias("n")).first().n or 0
    tasks = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(work / TASK_BYTES))
    return one.repartitionByRange(tasks, "shard", "offset").sortWithinPartitions("shard", "offset")


def reads(batch: pa.RecordBatch, most: int | None = None) -> Iterator[bytes]:
    """The stored bytes of each row of places(), or their first `most`, by range reads."""
    name, file = None, None
    at = [batch.column(batch.schema.get_field_index(n)).to_pylist() for n in ("shard", "offset", "length")]
    try:
        for shard, offset, length in zip(*at, strict=True):
            if shard != name:
                if file is not None:
                    file.close()
                fs, path = filesystem(shard)
                name, file = shard, fs.open_input_file(path)
            yield file.read_at(length if most is None else min(length, most), offset)
    finally:
        if file is not None:
            file.close()


def extended(df: DataFrame, columns: list[tuple[str, str, pa.DataType]], make) -> DataFrame:
    """df with more columns: make gives their values for each row of a batch."""

    def more(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = list(make(batch))
            new = [pa.array([r[k] for r in rows], t) for k, (_, _, t) in enumerate(columns)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=[*batch.schema.names, *(n for n, _, _ in columns)])

    return df.mapInArrow(more, ", ".join([f"`{n}` {t}" for n, t in df.dtypes] + [f"{n} {t}" for n, t, _ in columns]))


def described(at: DataFrame) -> DataFrame:
    """places() with width, height, bits and colour, from header-only range reads."""
    kinds = [(n, "int", pa.int32()) for n in ("width", "height", "bits", "colour")]
    return extended(at, kinds, lambda batch: map(header, reads(batch, HEADER_BYTES)))


def features(data: bytes) -> str:
    """Rows, sum, sum of squares, number of distinct samples and counts of eight ranges of samples."""
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    level = np.arange(256)
    return f"rows={len(data) // WIDTH};sum={int(counts @ level)};squares={int(counts @ level**2)};distinct={int((counts > 0).sum())};ranges={','.join(map(str, counts.reshape(8, 32).sum(1)))}"


def measured(at: DataFrame) -> DataFrame:
    """places() with what the stored bytes give when read back and decoded."""

    def make(batch: pa.RecordBatch) -> Iterator[tuple]:
        for raw in reads(batch):
            data = decoded(raw)
            yield hashlib.sha256(data).hexdigest(), zlib.crc32(data[-WIDTH:]), len(raw), hashlib.sha256(raw).hexdigest(), features(data)

    kinds = [("payload_sha256", "string", pa.string()), ("tail_crc32", "long", pa.int64()), ("media_bytes", "long", pa.int64()), ("media_sha256", "string", pa.string()), ("feature", "string", pa.string())]
    return extended(at, kinds, make)


def media_columns(docs: DataFrame, folder: str) -> DataFrame:
    """doc_id, n_bytes, payload_bytes, digest and the place of each document's payload (shard, offset, length), with what header
    reads and whole reads of that place give."""
    rows = written(stored(docs, folder), "media")
    found = written(measured(described(places(rows))), "measured")
    return matched(rows.select("doc_id", "n_bytes", "payload_bytes", "digest"), found, ["digest"], "doc_id")


def op2_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = media_columns(table(spark, sf_dir, "documents"), scratch(spark, "shards")).withColumn("shard", F.element_at(F.split("shard", "/"), -1))
    return out.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "width", "height", "shard", "offset", "length")


def media_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can tell of op2_media's columns: lengths and the digest of the payload that was read back."""
    return op2_media(spark, sf_dir).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256")


PAYLOADS_SQL = """
with d as (select doc_id, encode(coalesce(text, '')) as t, octet_length(encode(coalesce(text, ''))) as n from documents),
p as (select *, greatest(1, (n + 63) // 64) * 64 as m from d)
select doc_id, n::bigint as n_bytes, m::bigint as payload_bytes, sha256(t || unhex(repeat('00', (m - n)::int))) as payload_sha256 from p
"""
