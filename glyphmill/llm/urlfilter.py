"""URL filters: a trie over reversed host labels and path segments, with longest-match precedence.

A rule is (verdict, "host/path"). It fits its host and every subdomain if the URL's path starts with the rule's path;
more host labels, then a longer path, win. Rules go to the tasks in a broadcast trie if they hold `block_bytes` at most; a
longer list becomes several files in the shared folder, of which a task holds one trie at a time for HELD_ROWS URLs, and the
best match over all of them counts.

A null URL or one without "://" has empty host and path, fits no rule and gets the default verdict. Repeated rows and
other columns are left as they are; an empty table gives no rows.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import filesystem, scratch, table

RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
BLOCK_BYTES, HELD_ROWS, DEFAULT = 16 << 20, 1 << 19, "allow"
#: Keys of a trie node that no label or segment can equal.
PATHS, TAILS, END = 0, 1, 2


def trie(rules: Iterable[tuple[str, str]]) -> dict:
    root: dict = {}
    for verdict, rule in rules:
        host, slash, rest = rule.partition("/")
        node = root
        for label in reversed(host.split(".")):
            node = node.setdefault(label, {})
        *whole, tail = (slash + rest).split("/")
        node = node.setdefault(PATHS, {})
        for segment in whole:
            node = node.setdefault(segment, {})
        if tail:  # the rule ends inside a segment
            node.setdefault(TAILS, {})[tail] = (rule, verdict)
        else:
            node[END] = (rule, verdict)
    return root


def longest_path(node: dict, path: str) -> tuple[int, str, str] | None:
    """Length of the path matched, rule and verdict of the longest rule below a host's node."""
    best, rest, depth = None, path.split("/"), 0
    for k, segment in enumerate(rest):
        if END in node:
            best = (depth, *node[END])
        for tail, found in node.get(TAILS, {}).items():
            if segment.startswith(tail) and (best is None or depth + len(tail) > best[0]):
                best = (depth + len(tail), *found)
        if k == len(rest) - 1 or segment not in node:
            break
        node, depth = node[segment], depth + len(segment) + 1
    return best


def match(root: dict, host: str, path: str) -> tuple[int, int, str, str] | None:
    """Host labels, path length, rule and verdict of the longest rule that fits."""
    best, node = None, root
    for depth, label in enumerate(reversed(host.split(".")) if host else (), 1):
        node = node.get(label)
        if node is None:
            break
        if PATHS in node and (found := longest_path(node[PATHS], path)):
            best = (depth, *found)
    return best


def blocks(rules: Iterable[tuple[str, str]], most: int) -> Iterable[list[tuple[str, str]]]:
    held, size = [], 0
    for rule in rules:
        held.append(rule)
        size += len(rule[1]) + 64
        if size >= most:
            yield held
            held, size = [], 0
    if held:
        yield held


def together(batches: Iterator[tuple[pd.Series, pd.Series]], rows: int) -> Iterator[tuple[pd.Series, pd.Series]]:
    """Batches of at least so many rows, but for the last."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += len(batch[0])
        if size >= rows:
            yield tuple(map(pd.concat, zip(*held, strict=True)))
            held, size = [], 0
    if held:
        yield tuple(map(pd.concat, zip(*held, strict=True)))


def saved(spark: SparkSession, parts: list[list[tuple[str, str]]]) -> list[str]:
    """Blocks of rules as files in the shared folder."""
    folder, out = scratch(spark, "rules"), []
    fs, at = filesystem(folder)
    fs.create_dir(at, recursive=True)
    for k, part in enumerate(parts):
        with fs.open_output_stream(f"{at}/block-{k:06d}.json") as file:
            file.write(json.dumps(part).encode())
        out.append(f"{folder}/block-{k:06d}.json")
    return out


def load(path: str) -> list[list[str]]:
    fs, at = filesystem(path)
    with fs.open_input_file(at) as file:
        return json.loads(file.read())


def judged(pages: DataFrame, rules: Iterable[tuple[str, str]] = RULES, default: str = DEFAULT, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """pages with host, path, rule and verdict after its columns; such columns of its own are replaced."""
    sc = pages.sparkSession.sparkContext
    host = F.translate(F.regexp_extract("url", r"(?s)^.*?://([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract("url", r"(?s)^.*?://[^/?#]*([^?#]*)", 1)
    out = pages.withColumns({"host": F.coalesce(host, F.lit("")), "path": F.coalesce(path, F.lit(""))})
    kind = "struct<labels int, depth int, rule string, verdict string>"
    parts = list(blocks(rules, block_bytes))
    if len(parts) > 1:  # files, of which a task holds one at a time
        paths = saved(pages.sparkSession, parts)
    else:
        sent = sc.broadcast(trie(parts[0] if parts else []))  # block_bytes of rules at most

    def tries() -> Iterator[dict]:
        if len(parts) > 1:
            for path in paths:
                yield trie(load(path))
        else:
            yield sent.value

    count = len(parts)

    @F.pandas_udf(kind)
    def longest(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for hosts, paths_ in together(batches, HELD_ROWS if count > 1 else 1):
            best: list = [(-1, -1, None, None)] * len(hosts)
            for root in tries():
                found = (match(root, h, p) for h, p in zip(hosts, paths_, strict=True))
                best = [max(b, f, key=lambda x: x[:2]) if f else b for b, f in zip(best, found, strict=True)]
            yield pd.DataFrame(best, columns=["labels", "depth", "rule", "verdict"])

    best = longest("host", "path")
    out = out.withColumn("rule", best)
    return out.withColumns({"rule": F.col("rule.rule"), "verdict": F.coalesce("rule.verdict", F.lit(default))})


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict")


OP4_SQL = r"""
with p as (
  select page_id, coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), '') as h,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') as path from pages),
q as (select page_id, translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host, path from p),
r as (select page_id, host, path, case
    when ('.' || host) like '%.example.net' and starts_with(path, '/en/') then 'example.net/en/'
    when ('.' || host) like '%.example.com' and starts_with(path, '/de/') then 'example.com/de/'
    when ('.' || host) like '%.net' and starts_with(path, '/') then 'net/'
    when ('.' || host) like '%.org' and starts_with(path, '/fr/') then 'org/fr/' end as rule from q)
select page_id, host, path, rule, case when rule in ('net/', 'example.com/de/') then 'block' else 'allow' end as verdict from r
"""
