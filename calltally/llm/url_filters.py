"""URL filters: a trie over reversed host labels, then path segments, with longest-match precedence.

A rule is (action, host, path). It fits a URL whose host is the rule's host or a subdomain of it and whose path
starts with the rule's path. Of the rules that fit, the one with the most host labels wins, then the one with the
longest path; of two rules for the same host and path, ``block`` wins.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import packed, table

#: The production rules of the query (fixed values).
RULES = [
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
]
#: A rule list up to this many entries is broadcast as a trie; a longer one is joined.
MAX_BROADCAST_RULES = 200_000

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; null or no ``://``: empty."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def url_path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; null or no ``://``: empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def build_trie(rules: Iterable[tuple[str, str, str]]) -> dict:
    """Nested dicts: host labels from the last one on, then under key ``None`` a trie of path segments.

    A path ``/a/b`` has the segments ``/a`` and ``/b``. Its last segment may end inside a segment of a URL, so it is
    kept under key ``""`` as an entry (segment prefix, rule, action); the others are edges. Under key ``0`` are the
    lengths of a node's entries, longest first, so that a lookup tries those alone, however long the URL is.
    """
    root: dict = {}
    with_ends: dict[int, dict] = {}
    for action, host, path in rules:
        node = root
        for label in reversed(host.split(".")) if host else ():
            node = node.setdefault(label, {})
        node = node.setdefault(None, {})
        segments = _segments(path)
        for s in segments[:-1]:
            node = node.setdefault(s, {})
        ends = node.setdefault("", {})
        last = segments[-1] if segments else ""
        if ends.get(last, ("", ""))[1] != "block":
            ends[last] = (f"{host}{path}", action)
        with_ends[id(node)] = node
    for node in with_ends.values():
        node[0] = sorted({len(x) for x in node[""]}, reverse=True)
    return root


def _segments(path: str) -> list[str]:
    head, *rest = path.split("/")
    return ([head] if head else []) + ["/" + x for x in rest]


def _longest(paths: dict, segments: list[str]) -> tuple[str, str] | None:
    best, node = None, paths
    for s in [*segments, ""]:
        ends = node.get("")
        if ends:
            for n in node[0]:
                if n <= len(s) and s[:n] in ends:
                    best = ends[s[:n]]
                    break
        node = node.get(s) if s else None
        if node is None:
            break
    return best


def lookup(trie: dict, host: str, path: str) -> tuple[str, str] | None:
    """(rule, action) of the longest match, or None."""
    found, node = [], trie
    labels = host.split(".")[::-1] if host else []
    segments = _segments(path)
    if None in node:
        found.append(node[None])
    for label in labels:
        node = node.get(label)
        if node is None:
            break
        if None in node:
            found.append(node[None])
    for paths in reversed(found):
        if (hit := _longest(paths, segments)) is not None:
            return hit
    return None


def judge_urls(urls: DataFrame, rules: DataFrame | list[tuple[str, str, str]] = RULES, url_col: str = "url", default: str = "allow") -> DataFrame:
    """The columns of ``urls`` in a struct ``row``, and ``host``, ``path``, ``rule``, ``verdict``.

    No rule: ``rule`` is null and ``verdict`` is ``default``. Null URLs and URLs without ``://`` have an empty host and
    path, which no rule with a host fits. Repeated rows are judged one by one; an empty table gives an empty result.
    """
    spark = urls.sparkSession
    if isinstance(rules, DataFrame):
        bounded = rules.select("action", "host", "path").limit(MAX_BROADCAST_RULES + 1).collect()
        if len(bounded) > MAX_BROADCAST_RULES:
            return _judge_by_join(urls, rules, url_col, default)
        rules = [tuple(r) for r in bounded]
    elif len(rules) > MAX_BROADCAST_RULES:
        return _judge_by_join(urls, spark.createDataFrame(rules, "action string, host string, path string"), url_col, default)
    trie = spark.sparkContext.broadcast(build_trie(rules))
    cut = packed(urls).withColumns({"host": url_host(F.col("row")[url_col]), "path": url_path(F.col("row")[url_col])})

    def judge(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            hits = [lookup(trie.value, h, p) for h, p in zip(b.column("host").to_pylist(), b.column("path").to_pylist(), strict=True)]
            rule, verdict = pa.array([h and h[0] for h in hits], pa.string()), pa.array([h[1] if h else default for h in hits], pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns, rule, verdict], [*b.schema.names, "rule", "verdict"])

    schema = T.StructType([*cut.schema.fields, T.StructField("rule", T.StringType()), T.StructField("verdict", T.StringType())])
    return cut.mapInArrow(judge, schema)


def _judge_by_join(urls: DataFrame, rules: DataFrame, url_col: str, default: str) -> DataFrame:
    """Beyond the bound: equi-join each host suffix and path prefix of a URL with the rules."""
    cut = packed(urls).withColumns({"host": url_host(F.col("row")[url_col]), "path": url_path(F.col("row")[url_col])})
    labels = F.split("host", r"\.")
    n_labels = lambda h: F.when(h == "", 0).otherwise(F.size(F.split(h, r"\.")))
    # Only prefixes and suffixes as long as some rule's are tried: one row of lengths, bounded by the longest rule.
    lengths = F.broadcast(rules.agg(F.collect_set(F.length("path")).alias("_paths"), F.collect_set(n_labels(F.col("host"))).alias("_hosts")))
    keys = cut.select("host", "path").distinct().join(lengths)
    suffixes = F.transform(
        F.filter("_hosts", lambda n: n <= n_labels(F.col("host"))), lambda n: F.when(n == 0, "").otherwise(F.array_join(F.slice(labels, F.size(labels) - n + 1, n), "."))
    )
    tried = keys.select("host", "path", "_paths", F.explode(suffixes).alias("_h")).select(
        "host", "path", "_h", F.explode(F.transform(F.filter("_paths", lambda n: n <= F.length("path")), lambda n: F.substring("path", F.lit(1), n))).alias("_p")
    )
    ranked = rules.groupBy(F.col("host").alias("_h"), F.col("path").alias("_p")).agg(F.max("action").alias("_a"))  # block > allow
    best = (
        tried.join(ranked, ["_h", "_p"])
        .groupBy("host", "path")
        .agg(F.max(F.struct(n_labels(F.col("_h")), F.length("_p"), F.concat("_h", "_p").alias("rule"), F.col("_a").alias("action"))).alias("_b"))
        .select("host", "path", F.col("_b.rule").alias("rule"), F.col("_b.action").alias("_v"))
    )
    return cut.join(best, ["host", "path"], "left").select("row", "host", "path", "rule", F.coalesce("_v", F.lit(default)).alias("verdict"))


def op8_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages")).select("row.page_id", "host", "path", "rule", "verdict")


ORACLE = r"""
WITH u AS (
  SELECT page_id,
         translate(coalesce(regexp_extract(url, '^[\s\S]*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '^[\s\S]*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
r(action, rh, rp) AS (VALUES ('block','com','/en/'),('allow','example.com','/en/7'),('allow','net','/de/'),('block','example.net','/de/8'),('block','org','/es/')),
m AS (
  SELECT page_id, host, path, rh || rp AS rule, action,
         row_number() OVER (PARTITION BY page_id, host, path ORDER BY length(rh) DESC, length(rp) DESC) AS n
  FROM u JOIN r ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp))
SELECT u.page_id, u.host, u.path, m.rule, coalesce(m.action, 'allow') AS verdict
FROM u LEFT JOIN m ON u.page_id = m.page_id AND u.host = m.host AND u.path = m.path AND m.n = 1
"""
