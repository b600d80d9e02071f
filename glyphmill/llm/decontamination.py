"""Benchmark decontamination: a prefix-filtered set join of item windows with documents.

A window is `window` consecutive words of an item (an item of fewer words is one window), a set of `shingle`-word
shingles. Shingles are ordered by rarity in the corpus. A document that contains a share `containment` of a window's
shingles must hold one of the first n - ceil(containment * n) + 1 of them; only those are looked up. Each hit places
the window in the document: windows that would reach outside of it go, the others are verified by exact words.

The benchmark is cut into index blocks of about `block_bytes` of text, files in the shared folder, made in parallel; a task
holds one at a time, for HELD_BYTES of documents, so a benchmark of any size is handled and nothing is broadcast. Documents
are read twice (rarity, join), and never shuffled.

A null or empty text has no words; an item without words has no window. Items are told apart by item_id, a
null one being named ""; repeated rows
are documents of their own; an empty benchmark hits nothing; other columns are not read.
"""

from __future__ import annotations

import hashlib
import io
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import filesystem, joined, kept_columns, lengths, scratch, slices, table, utf8, written
from .words import ALNUM, LOWER, Lookup, Words, repeats

WINDOW, SHINGLE, BLOCK_BYTES, HELD_BYTES = 10, 3, 8 << 20, 64 << 20


def save(uri: str, **arrays: np.ndarray) -> None:
    fs, path = filesystem(uri)
    fs.create_dir(path.rpartition("/")[0], recursive=True)
    out = io.BytesIO()
    np.savez(out, **arrays)
    with fs.open_output_stream(path) as file:
        file.write(out.getvalue())


def load(uri: str) -> dict[str, np.ndarray]:
    fs, path = filesystem(uri)
    with fs.open_input_file(path) as file:
        return dict(np.load(io.BytesIO(file.read())))


def window_table(items: np.ndarray, texts: list[bytes], window: int, shingle: int) -> dict[str, np.ndarray]:
    """A block's windows: item, length, words (hash, and bytes by place), and one row for each shingle of a window."""
    raw = LOWER[np.frombuffer(b"".join(texts), np.uint8)]
    w = Words(raw, np.concatenate([[0], np.cumsum([len(t) for t in texts], dtype=np.int64)]).astype(np.int64))
    n = np.diff(w.first)
    length = np.minimum(n, window)
    count = np.where(n > 0, n - length + 1, 0)
    start, size = repeats(w.first[:-1], count), np.repeat(length, count)
    width = np.minimum(size, shingle)
    per = size - width + 1
    of, at = np.repeat(np.arange(len(start)), per), repeats(np.zeros(len(start), np.int64), per)
    value = np.zeros(len(of), np.uint64)
    for k in np.unique(width):
        h, first = w.shingles(int(k))
        place = np.full(len(w), -1)
        place[first] = np.arange(len(first))
        rows = width[of] == k
        value[rows] = h[place[(start[of] + at)[rows]]]
    return {"item": np.repeat(items, count), "size": size, "start": start, "hash": w.hash, "raw": raw, "left": w.start, "right": w.end, "of": of, "at": at, "width": width[of], "value": value}


def indexed(bench: DataFrame, folder: str, window: int = WINDOW, shingle: int = SHINGLE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Writes the benchmark's blocks to folder and returns their paths."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, task = [], TaskContext.get()
        for batch in batches:
            for part in slices(batch, "text", block_bytes):
                names.append(f"{folder}/block-{task.partitionId():06d}-{task.taskAttemptId()}-{len(names):04d}.npz")
                items = np.array([str(x).encode() if x is not None else b"" for x in part.column(0).to_pylist()])
                save(names[-1], **window_table(items, [x.as_py() for x in utf8(part.column(1))], window, shingle))
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string())], names=["path"])

    bench = kept_columns(bench, ["item_id", "text"])
    work = bench.agg(F.sum(F.octet_length("text")).alias("n")).first().n or 0
    return written(bench.repartition(max(1, -(-work // block_bytes))).mapInArrow(build, "path string"), "blocks")  # a task for each block


def together(batches: Iterator[pa.RecordBatch], column: int, most: int) -> Iterator[list[pa.RecordBatch]]:
    """Slices of batches, as many at once as hold `most` bytes of text."""
    held, size = [], 0
    for batch in batches:
        for part in slices(batch):
            held.append(part)
            size += int(lengths(utf8(part.column(column))).sum())
            if size >= most:
                yield held
                held, size = [], 0
    if held:
        yield held


def rarity(docs: DataFrame, paths: list[str]) -> DataFrame:
    """path, value and n: how often each item shingle occurs in all documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables: dict[str, dict[int, Lookup]] = {}
        totals: dict[tuple[str, int], np.ndarray] = {}
        for parts in together(batches, 0, most):
            for path in paths:  # one block in memory at a time
                if path not in tables:
                    yield from flushed(tables, totals)
                    block = load(path)
                    tables[path] = {k: Lookup(np.unique(block["value"][block["width"] == k])) for k in np.unique(block["width"]).tolist()}
                for part in parts:
                    raw, off = joined(utf8(part.column(0)))
                    w = Words(LOWER[raw], off)
                    for k, find in tables[path].items():
                        seen = totals.setdefault((path, k), np.zeros(len(find.keys), np.int64))
                        seen += np.bincount(find(w.shingles(k)[0])[1], minlength=len(find.keys))
        yield from flushed(tables, totals)

    def flushed(tables: dict, totals: dict) -> Iterator[pa.RecordBatch]:
        for (path, k), seen in totals.items():
            hit = np.flatnonzero(seen)
            yield counted(path, tables[path][k].keys[hit], seen[hit])
        tables.clear()
        totals.clear()

    def counted(path: str, keys: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([path] * len(n), pa.string()), pa.array(keys.view(np.int64)), pa.array(n)], names=["path", "value", "n"])

    most = HELD_BYTES if len(paths) > 1 else 0
    return docs.select("text").mapInArrow(count, "path string, value long, n long").groupBy("path", "value").agg(F.sum("n").alias("n"))


def ranked(paths: DataFrame, counts: DataFrame, folder: str, containment: float) -> DataFrame:
    """Blocks whose shingles are cut to each window's necessary prefix, rarest first; returns their paths."""

    def cut(key, left, right):
        import pandas as pd

        (path,) = key
        block = load(path)
        known = right.sort_values("value")
        keys = known["value"].to_numpy().astype(np.int64)
        seen = np.zeros(len(block["value"]), np.int64)
        if len(keys):
            at = np.searchsorted(keys, block["value"].view(np.int64))
            at[at == len(keys)] = 0
            same = keys[at] == block["value"].view(np.int64)
            seen[same] = known["n"].to_numpy()[at[same]]
        order = np.lexsort((block["at"], block["value"], seen, block["of"]))
        of = block["of"][order]
        place = np.arange(len(of)) - np.searchsorted(of, of)
        per = np.bincount(of, minlength=len(block["size"]))[of]
        need = per - np.ceil(containment * per - 1e-9).astype(np.int64) + 1
        keep = order[place < need]
        keep = keep[np.lexsort((block["value"][keep], block["width"][keep]))]
        block |= {k: block[k][keep] for k in ("of", "at", "width", "value")}
        out = f"{folder}/ranked-{hashlib.sha1(path.encode()).hexdigest()}.npz"
        save(out, **block)
        return pd.DataFrame({"path": [out]})

    pair = paths.groupBy("path").cogroup(counts.groupBy("path"))
    return written(pair.applyInPandas(cut, "path string"), "ranked")


class Index:
    """A ranked block, ready for lookup."""

    def __init__(self, block: dict[str, np.ndarray]):
        self.b, self.by = block, {}
        for k in np.unique(block["width"]).tolist():
            rows = np.flatnonzero(block["width"] == k)
            keys, first, count = np.unique(block["value"][rows], return_index=True, return_counts=True)
            self.by[k] = Lookup(keys), rows[first], count

    def words(self, window: int) -> tuple[bytes, ...]:
        b, at = self.b, int(self.b["start"][window])
        return tuple(b["raw"][x:y].tobytes() for x, y in zip(b["left"][at : at + int(b["size"][window])], b["right"][at : at + int(b["size"][window])], strict=True))

    def hits(self, w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First word, number of words and window of each verified occurrence in w."""
        b, found = self.b, []
        for k, (find, first, count) in self.by.items():
            h, at = w.shingles(k)
            i, j = find(h)
            row = repeats(first[j], count[j])
            found.append((np.repeat(at[i], count[j]) - b["at"][row], b["of"][row]))
        start, window = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        inside = start >= 0  # positional bound, then length bound: the whole window lies in the text of its shingle
        start, window = start[inside], window[inside]
        size = b["size"][window]
        last = start + size - 1
        ok = last < len(w)
        ok[ok] &= w.text[start[ok]] == w.text[last[ok]]
        start, window, size = start[ok], window[ok], size[ok]
        for k in range(int(size.max(initial=0))):
            on = np.flatnonzero(size > k)
            same = w.hash[start[on] + k] == b["hash"][b["start"][window[on]] + k]
            if not same.all():
                bad = np.ones(len(start), bool)
                bad[on[~same]] = False
                start, window, size = start[bad], window[bad], size[bad]
        pairs = np.unique(np.stack([start, window]), axis=1) if len(start) else np.zeros((2, 0), np.int64)
        start, window = pairs
        size = b["size"][window]
        exact, known = np.ones(len(start), bool), {}
        for n, (s, v, z) in enumerate(zip(start.tolist(), window.tolist(), size.tolist(), strict=True)):
            if v not in known:
                known[v] = self.words(v)
            exact[n] = known[v] == tuple(w.raw[x:y].tobytes() for x, y in zip(w.start[s : s + z], w.end[s : s + z], strict=True))
        return start[exact], size[exact], window[exact]


def marked(docs: DataFrame, bench: DataFrame, window: int = WINDOW, shingle: int = SHINGLE, containment: float = 1.0, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs with n_words, n_hit and items (their ids as strings, sorted) after its columns.

    Windows are matched whole (containment 1), so a window's necessary prefix is its rarest shingle.
    """
    if containment != 1.0:
        raise ValueError("occurrences are exact windows")
    spark = docs.sparkSession
    folder = scratch(spark, "bench")
    blocks = indexed(bench, folder, window, shingle, block_bytes)
    raw_paths = [r.path for r in blocks.toLocalIterator()]  # one for each block_bytes of benchmark text
    counts = written(rarity(docs, raw_paths), "rarity") if raw_paths else spark.createDataFrame([], "path string, value long, n long")
    paths = sorted(r.path for r in ranked(blocks, counts, folder, containment).toLocalIterator())
    names = [n for n in docs.columns if n not in ("n_words", "n_hit", "items")]
    place = names.index("text")

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index: dict[str, Index] = {}
        for parts in together(batches, place, HELD_BYTES if len(paths) > 1 else 0):
            covered: list[np.ndarray | None] = [None] * len(parts)
            items: list[list[set[bytes]]] = [[set() for _ in range(part.num_rows)] for part in parts]
            first: list[np.ndarray] = [np.zeros(0)] * len(parts)
            for path in paths or [None]:  # one block in memory at a time
                if path is not None and path not in index:
                    index.clear()
                    index[path] = Index(load(path))
                for k, part in enumerate(parts):
                    raw, off = joined(utf8(part.column(place)))
                    w = Words(LOWER[raw], off)
                    first[k] = w.first
                    edge = np.zeros(len(w) + 1, np.int64)
                    if path is not None:
                        start, size, found = index[path].hits(w)
                        np.add.at(edge, start, 1)
                        np.add.at(edge, start + size, -1)
                        for text, item in zip(w.text[start].tolist(), index[path].b["item"][found].tolist(), strict=True):
                            items[k][text].add(item)
                    hit = np.packbits(np.cumsum(edge[:-1]) > 0)
                    covered[k] = hit if covered[k] is None else covered[k] | hit
            for part, hit, own, start in zip(parts, covered, items, first, strict=True):
                total = np.concatenate([[0], np.cumsum(np.unpackbits(hit, count=int(start[-1])), dtype=np.int64)])
                new = [pa.array(np.diff(start)), pa.array(np.diff(total[start])), pa.array([sorted(x.decode() for x in s) for s in own], pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays([*part.columns, *new], names=[*names, "n_words", "n_hit", "items"])

    kinds = ", ".join([f"`{n}` {t}" for n, t in docs.select(*[f"`{n}`" for n in names]).dtypes] + ["n_words long", "n_hit long", "items array<string>"])
    return kept_columns(docs, names).mapInArrow(mark, kinds)


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = marked(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    digest = F.sha2(F.array_join("items", ","), 256)
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), digest.alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


OP7_SQL = r"""
with i as (select item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
b as (select distinct item_id, k, unnest(list_transform(generate_series(1, len(w) - k + 1), lambda j: array_to_string(w[j:j + k - 1], ' '))) as win from (select *, least(10, len(w)) as k from i where len(w) > 0)),
d as (select doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) as w from documents),
x as (select doc_id, k, unnest(generate_series(1, len(w) - k + 1)) as j, unnest(list_transform(generate_series(1, len(w) - k + 1), lambda j: array_to_string(w[j:j + k - 1], ' '))) as win from d, (select distinct k from b) where len(w) >= k),
m as (select x.doc_id, x.j, x.k, b.item_id from x join b on x.k = b.k and x.win = b.win),
h as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(generate_series(j, j + k - 1)) as p from m) group by doc_id),
t as (select doc_id, count(*) as n_items, string_agg(id, ',' order by id) as ids from (select distinct doc_id, item_id::varchar as id from m) group by doc_id)
select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items, sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join h using (doc_id) left join t using (doc_id)
"""
