"""WARC archives: writing with revisits, segments and chunked framing; reading with segment reassembly.

Records are gzip members. A response whose block is longer than `segment_bytes` becomes a first record and continuation
records. Each task writes the records of its pages, as responses, to a draft, once for each payload and lesser page_id; only narrow rows (page_id,
url, digest, place in the draft) are shuffled. They tell which page is the response; its bytes are copied from
the draft by range reads, and all others become revisit records, so no payload crosses the network by its digest. Reading
shuffles continuation parts by their origin's record id, orders them by segment number, verifies the total length and
decodes the chunked transfer framing, a record at a time. An archive is named after its task attempt, so a task that runs
again writes files of its own, and begins with a warcinfo record.

A null payload is empty. Among equal payloads the smallest page_id is the response, null only if all are null; rows that
repeat it are responses too. A record that can't be reassembled keeps its row, with `problem` saying why. An empty
table writes nothing and gives no rows; other columns are not read. A very long payload is one record, held a few times over in
one task. Records of other types than response, revisit and continuation give no row.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import dropped, filesystem, kept_columns, matched, removed, scratch, slices, table, utf8, written

SEGMENT_BYTES, CHUNK_BYTES, ARCHIVE_BYTES, READ_BYTES, TASK_BYTES = 32 << 10, 4 << 10, 128 << 20, 32 << 10, 8 << 20
DATE = "2024-01-01T00:00:00Z"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
PARTS = "origin string, number int, total long, kind string, page_id long, refers_to long, digest string, payload_bytes long, block binary, problem string"
TYPES = (pa.string(), pa.int32(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.binary(), pa.string())


def base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def chunked(data: bytes, size: int = CHUNK_BYTES) -> bytes:
    parts = [b"%X\r\n%b\r\n" % (len(p), p) for p in (data[k : k + size] for k in range(0, len(data), size))]
    return b"".join(parts) + b"0\r\n\r\n"


def dechunked(body: bytes) -> bytes:
    """The data of a chunked body; chunk extensions and trailers are passed over."""
    out, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        size = int(body[at:end].split(b";")[0], 16)
        if not size:
            return b"".join(out)
        if body[end + 2 + size : end + 4 + size] != b"\r\n":
            raise ValueError("chunk framing")
        out.append(body[end + 2 : end + 2 + size])
        at = end + 4 + size


def content(block: bytes) -> bytes:
    """The payload of an HTTP response block."""
    head, gap, body = block.partition(b"\r\n\r\n")
    if not gap:
        raise ValueError("HTTP header")
    return dechunked(body) if b"transfer-encoding: chunked" in head.lower() else body


def record(fields: list[tuple[str, object]], block: bytes) -> bytes:
    lines = "".join(f"{k}: {v}\r\n" for k, v in fields if v is not None)
    return gzip.compress(f"WARC/1.1\r\n{lines}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n", 6, mtime=0)


def record_id(name: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}>"


def target(url: str | None) -> str | None:
    return None if url is None else quote(url, safe="%/:?#[]@!$&'()*+,;=~")


def response(page_id: object, url: str | None, data: bytes, name: str, segment_bytes: int, chunk_bytes: int = CHUNK_BYTES) -> Iterator[bytes]:
    """The record of a page, or its segments. `name` tells apart records that are otherwise alike."""
    own, kind = record_id(name), ("Content-Type", "application/http; msgtype=response")
    fields = [("WARC-Type", "response"), ("WARC-Record-ID", own), ("WARC-Date", DATE), ("WARC-Target-URI", target(url)), ("WARC-Payload-Digest", f"sha1:{base32(data)}"), ("Page-ID", page_id)]
    block = HTTP + chunked(data, chunk_bytes)
    parts = [block[k : k + segment_bytes] for k in range(0, len(block), segment_bytes)]
    if len(parts) == 1:
        yield record([*fields, kind], block)
        return
    yield record([*fields, ("WARC-Segment-Number", 1), kind], parts[0])
    for k, part in enumerate(parts[1:], 2):
        total = ("WARC-Segment-Total-Length", len(block) if k == len(parts) else None)
        yield record([("WARC-Type", "continuation"), ("WARC-Record-ID", record_id(f"{name}/{k}")), ("WARC-Date", DATE), ("WARC-Target-URI", target(url)), ("WARC-Segment-Origin-ID", own), ("WARC-Segment-Number", k), total], part)


def revisit(page_id: object, url: str | None, digest: str, name: str, refers_to: object, refers_to_id: str) -> bytes:
    """The record of a page whose payload is that of another's response."""
    profile = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
    fields = [("WARC-Type", "revisit"), ("WARC-Record-ID", record_id(name)), ("WARC-Date", DATE), ("WARC-Target-URI", target(url)), ("WARC-Payload-Digest", f"sha1:{digest}"), ("Page-ID", page_id)]
    return record([*fields, ("WARC-Profile", profile), ("WARC-Refers-To", refers_to_id), ("Refers-To-Page-ID", refers_to), ("Content-Type", "application/http; msgtype=response")], HTTP)


class Archives:
    """The files that a task attempt writes, each of about `most` bytes."""

    def __init__(self, folder: str, kind: str, suffix: str, most: int, info: bool):
        self.fs, self.at = filesystem(folder)
        self.folder, self.suffix, self.most, self.info = folder, suffix, most, info
        task = TaskContext.get()
        self.stem = f"{kind}-{task.partitionId():06d}-{task.taskAttemptId()}" if task else kind
        self.names, self.out, self.size = [], None, 0

    def put(self, data: bytes) -> tuple[str, int]:
        """The file that data went to, and where."""
        if self.out is None or self.size >= self.most:
            self.close()
            self.fs.create_dir(self.at, recursive=True)
            name = f"{self.stem}-{len(self.names):04d}{self.suffix}"
            self.names.append(f"{self.folder}/{name}")
            self.out, self.size = self.fs.open_output_stream(f"{self.at}/{name}", compression=None), 0
            if self.info:
                self.put(record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", record_id(f"{name}/info")), ("WARC-Date", DATE), ("WARC-Filename", name), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n"))
        place = self.names[-1], self.size
        self.out.write(data)
        self.size += len(data)
        return place

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.out = None


def drafted(pages: DataFrame, folder: str, segment_bytes: int, archive_bytes: int) -> DataFrame:
    """page_id, url, digest and name (what its record's id is made of) of each page, and draft, offset and length of its
    response record, of length 0 if the task has one of a lesser page_id for its payload."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, least, row = Archives(folder, "draft", ".gz", archive_bytes, False), {}, 0
        for batch in batches:
            for part in slices(batch, "html"):
                out = []
                for page_id, url, html in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), utf8(part.column(2)), strict=True):
                    data, name = html.as_py(), f"{files.stem}/{row}"
                    digest, order, row = base32(data), (page_id is None, page_id), row + 1
                    held = least.get(digest)
                    if held is None or order <= held:
                        least[digest] = order
                        at, size = files.put(b""), 0
                        for x in response(page_id, url, data, name, segment_bytes):
                            files.out.write(x)
                            size += len(x)
                        files.size += size
                        out.append((page_id, url, digest, name, *at, size))
                    else:
                        out.append((page_id, url, digest, name, files.names[-1], files.size, 0))
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array([r[k] for r in out], t) for k, t in enumerate((pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64()), 1))], names=["page_id", "url", "digest", "name", "draft", "offset", "length"])
        files.close()

    kind = dict(pages.dtypes)["page_id"]
    return kept_columns(pages, ["page_id", "url", "html"]).mapInArrow(write, f"page_id {kind}, url string, digest string, name string, draft string, offset long, length long")


def archived(pages: DataFrame, folder: str, segment_bytes: int = SEGMENT_BYTES, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes pages (page_id, url, html) as archives to folder and returns their paths."""
    spark, drafts = pages.sparkSession, scratch(pages.sparkSession, "drafts")
    rows = written(drafted(pages, drafts, segment_bytes, archive_bytes), "drafted")
    order = F.struct(F.col("page_id").isNull().alias("unknown"), "page_id", "name")
    firsts = written(rows.groupBy("digest").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("times")).select("digest", F.col("first.page_id").alias("first"), F.col("first.name").alias("to"), "times"), "firsts")
    known = firsts.withColumn("again", F.col("times") > 1)
    plan = written(matched(rows, known.where("again").drop("again"), ["digest"], "name").withColumn("response", F.col("to").isNull() | F.col("page_id").eqNullSafe(F.col("first"))), "plan")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, held, file = Archives(folder, "part", ".warc.gz", archive_bytes, True), None, None
        for batch in batches:
            for page_id, url, digest, name, draft, offset, length, first, to, whole in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if not whole:
                    files.put(revisit(page_id, url, digest, name, first, record_id(to)))
                    continue
                if draft != held:
                    if file is not None:
                        file.close()
                    fs, at = filesystem(draft)
                    held, file = draft, fs.open_input_file(at)
                files.put(file.read_at(length, offset))
        if file is not None:
            file.close()
        files.close()
        yield pa.RecordBatch.from_arrays([pa.array(files.names, pa.string())], names=["path"])

    work = plan.agg(F.sum(F.when(F.col("response"), F.col("length")).otherwise(256)).alias("n")).first().n or 0
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-work // TASK_BYTES))
    near = plan.repartitionByRange(tasks, "draft", "offset", "name").sortWithinPartitions("draft", "offset")
    out = written(near.select("page_id", "url", "digest", "name", "draft", "offset", "length", "first", "to", "response").mapInArrow(write, "path string"), "archives")
    for x in (rows, firsts, plan):
        dropped(x)
    removed(spark, drafts)
    return out


def members(file) -> Iterator[bytes]:
    """The gzip members of a file, unpacked one at a time."""
    unpack, parts = zlib.decompressobj(31), []
    while data := file.read(READ_BYTES):
        while data:
            parts.append(unpack.decompress(data))
            data = unpack.unused_data
            if unpack.eof:
                yield b"".join(parts)
                unpack, parts = zlib.decompressobj(31), []
    if parts:
        raise ValueError("cut gzip member")


def parsed(raw: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = raw.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}
    block = rest[: int(fields["content-length"])]
    if len(block) != int(fields["content-length"]):
        raise ValueError("cut record")
    return fields, block


def checked(block: bytes, digest: str | None) -> tuple[str | None, int | None, str | None]:
    """Digest and length of a block's payload, and what is wrong with it."""
    try:
        data = content(block)
    except ValueError as e:
        return digest, None, f"framing: {e}"
    return base32(data), len(data), None if digest in (None, base32(data)) else "payload digest differs"


def parts(paths: DataFrame) -> DataFrame:
    """A row for each record of the archives: whole ones digested, segments with their block."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                fs, at = filesystem(path)
                rows, held = [], 0
                with fs.open_input_stream(at, compression=None) as file:
                    for fields, block in map(parsed, members(file)):
                        if fields["warc-type"] not in ("response", "revisit", "continuation"):
                            continue
                        number, total = fields.get("warc-segment-number"), fields.get("warc-segment-total-length")
                        digest = fields.get("warc-payload-digest", "").removeprefix("sha1:") or None
                        origin, kind = fields.get("warc-segment-origin-id", fields["warc-record-id"]), fields["warc-type"]
                        page, refers = (None if (x := fields.get(n)) is None else int(x) for n in ("page-id", "refers-to-page-id"))
                        if number is not None:
                            rows.append((origin, int(number), None if total is None else int(total), kind, page, refers, digest, None, block, None))
                            held += len(block)
                        else:
                            found = (digest, None, None) if kind == "revisit" else checked(block, digest)
                            rows.append((origin, 0, None, kind, page, refers, found[0], found[1], None, found[2]))
                        if len(rows) >= 5000 or held >= 4 << 20:
                            yield batched(rows)
                            rows, held = [], 0
                yield batched(rows)

    return paths.repartition(max(1, paths.count())).mapInArrow(read, PARTS)


def batched(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(TYPES)], names=[x.split()[0] for x in PARTS.split(", ")])


def whole(rows: list[tuple]) -> tuple:
    """One record from its segments, ordered by number."""
    first, block = rows[0], b"".join(r[8] for r in rows)
    found: tuple = (first[6], None, None)
    if [r[1] for r in rows] != list(range(1, len(rows) + 1)):
        found = (first[6], None, "segments missing or repeated")
    elif rows[-1][2] != len(block):
        found = (first[6], None, "total length differs")
    else:
        found = checked(block, first[6])
    return (first[0], 0, None, first[3], first[4], first[5], found[0], found[1], None, found[2])


def reassembled(rows: DataFrame) -> DataFrame:
    """parts() with each record's segments put together: page_id, kind, refers_to, digest, payload_bytes, problem."""

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            out = []
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and row[0] != held[0][0]:
                    out.append(whole(held))
                    held = []
                held.append(row)
            yield batched(out)
        if held:
            yield batched([whole(held)])

    cut = rows.where("number > 0").repartition("origin").sortWithinPartitions("origin", "number").mapInArrow(join, PARTS)
    return rows.where("number = 0").unionByName(cut).select("page_id", "kind", "refers_to", "digest", "payload_bytes", "problem")


def read_back(paths: DataFrame) -> DataFrame:
    """reassembled() records of the archives, with revisits given the length of the payload that they refer to."""
    rows = written(parts(paths), "parts")
    out = written(reassembled(rows).withColumn("row", F.monotonically_increasing_id()), "records")
    dropped(rows)
    sizes = out.groupBy("digest").agg(F.min(F.when(F.col("kind") == "response", F.col("payload_bytes"))).alias("size"), F.count(F.lit(1)).alias("times")).where("times > 1")
    found = matched(out, written(sizes, "sizes"), ["digest"], "row")
    return found.withColumn("payload_bytes", F.coalesce("payload_bytes", "size")).select("page_id", "kind", "refers_to", "digest", "payload_bytes", "problem")


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = read_back(archived(table(spark, sf_dir, "pages"), scratch(spark, "warc")))
    return out.select("page_id", "payload_bytes", F.col("digest").alias("payload_digest"), F.col("kind").alias("record_type"), F.when(F.col("kind") == "revisit", F.col("refers_to")).alias("refers_to"), "problem")


OP10_SQL = """
with p as (select page_id, coalesce(html, '') as html, sha1(coalesce(html, '')) as h from pages),
q as (select *, min(page_id) over (partition by html) as first from p),
d as (select h, string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(h, 5 * (k // 4) + 1, 5))::int >> (15 - 5 * (k % 4)))::int & 31) + 1, 1), '' order by k) as digest
   from (select distinct h from p), (select unnest(generate_series(0, 31)) as k) group by h)
select page_id, octet_length(encode(html)) as payload_bytes, digest as payload_digest, case when page_id is not distinct from first then 'response' else 'revisit' end as record_type,
   case when page_id is distinct from first then first end as refers_to, null::varchar as problem from q join d using (h)
"""
