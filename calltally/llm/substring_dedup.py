"""Substring dedup with fixed-block anchors: remove every word that an exact repeat of enough words covers.

Blocks of ``(width + 1) // 2`` words that don't overlap are the reference blocks: any window of ``width`` words holds a
whole one. They are indexed by hash and probed with every rolling window of the same length; a block met at any other
place is a hit. Hits are extended word by word: each of the windows of ``width`` words around a hit block is looked up
in turn, and windows found twice unite to the maximal repeats.

How it runs: texts are dealt to groups by the hash of their row, once. A group sends its distinct window hashes, sorted
and packed, to ranges of the hash space; a range answers with one bit for each hash that the group asked about. So a
passage that every document holds costs one entry a group, pairs of places are never made, and the texts stay where
they are: the three steps over them read the same shuffle.
"""

from __future__ import annotations

from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import partitions, spread, table
from .rolling import U, Words, bits, cut_points, decode, edges, encode, unbits, windows

WIDTH = 35
#: Bits of a block's hash in the first step, which only has to find candidates.
PROBE_BITS = 48


class _Group:
    """The texts of one group."""

    def __init__(self, texts: pa.ChunkedArray, width: int):
        self.width, self.block = width, (width + 1) // 2
        self.words = Words(texts)
        self.ends = self.words.last()
        self.at = np.arange(len(self.ends))
        self.sums = self.words.sums()

    def probes(self) -> np.ndarray:
        return windows(self.sums, self.at[self.at + self.block <= self.ends], self.block) >> U(64 - PROBE_BITS)

    def blocks(self) -> tuple[np.ndarray, np.ndarray]:
        """First words of the reference blocks, and their hashes."""
        place = self.at - np.repeat(self.words.first[:-1], self.words.counts)
        starts = self.at[(place % self.block == 0) & (self.at + self.block <= self.ends)]
        return starts, windows(self.sums, starts, self.block) >> U(64 - PROBE_BITS)

    def candidates(self, hits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Windows that hold a hit block, in the order of their hashes: starts, two hashes, and where a new pair begins."""
        first = np.repeat(self.words.first[:-1], self.words.counts)
        starts = (hits[:, None] - np.arange(self.width - self.block + 1)[None, :]).ravel()
        near = np.maximum(starts, 0)
        # (An even width leaves room for two blocks in some windows.)
        starts = np.unique(starts[(starts >= np.repeat(first[hits], self.width - self.block + 1)) & (near + self.width <= np.repeat(self.ends[hits], self.width - self.block + 1))])
        h = windows(self.sums, starts, self.width)
        k = (windows(self.words.sums(1), starts, self.width) >> U(32)).astype(np.uint32)
        order = np.lexsort((k, h))
        h, k = h[order], k[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (k[1:] != k[:-1])
        return starts[order], h, k, new


def _hits(group: _Group, answers: dict[int, bytes], n_ranges: int) -> np.ndarray:
    """First words of the blocks that the answers call repeated."""
    starts, h = group.blocks()
    u, inverse = np.unique(h, return_inverse=True)
    hot = _answered(u, edges(n_ranges, PROBE_BITS), answers)
    return starts[hot[inverse]]


def _answered(ordered: np.ndarray, ends: np.ndarray, answers: dict[int, bytes]) -> np.ndarray:
    out, at = np.zeros(len(ordered), bool), cut_points(ordered, ends)
    for b, blob in answers.items():
        out[at[b] : at[b + 1]] = unbits(blob, at[b + 1] - at[b])
    return out


_PARTS = pa.schema([("r", pa.int32()), ("b", pa.int32()), ("g", pa.int32()), ("hashes", pa.binary()), ("more", pa.binary()), ("many", pa.binary())])
_ANSWERS = pa.schema([("g", pa.int32()), ("step", pa.int32()), ("b", pa.int32()), ("bits", pa.binary())])
_PARTS_SQL, _ANSWERS_SQL = "r int, b int, g int, hashes binary, more binary, many binary", "g int, step int, b int, bits binary"


def _by_step(answers: pa.Table) -> tuple[dict[int, bytes], dict[int, bytes]]:
    out: tuple[dict[int, bytes], dict[int, bytes]] = ({}, {})
    for step, b, blob in zip(*(answers.column(c).to_pylist() for c in ("step", "b", "bits")), strict=True):
        out[step - 1][b] = blob
    return out


def mark_repeats(docs: DataFrame, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``n_words``, ``n_removed`` and ``kept`` (the words left, joined by one space) of each row.

    A word goes if a window of ``width`` words over it starts at any other place too, in the same text included;
    windows are judged on the input. A null or empty text has no words. Repeated rows repeat each other, so all their
    windows go. Texts shorter than the window stay whole.
    """
    spark = docs.sparkSession
    n = partitions(spark)
    n_groups, n_ranges = 4 * n, n
    groups, ranges = spread(spark, n_groups), np.array(spread(spark, n_ranges))
    source = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    id_type = source.schema["doc_id"].dataType.simpleString()
    dealt = source.withColumn("g", F.get(F.array(*map(F.lit, groups)), F.pmod(F.xxhash64("doc_id", "text"), F.lit(n_groups)).cast("int"))).repartition(n, "g")

    def probe(group: pa.Table) -> pa.Table:
        g, own = group.column("g")[0].as_py(), _Group(group.column("text"), width)
        u, count = np.unique(own.probes(), return_counts=True)
        asked = np.zeros(len(u), bool)
        asked[np.searchsorted(u, own.blocks()[1])] = True
        at, rows = cut_points(u, edges(n_ranges, PROBE_BITS)), []
        for b in np.flatnonzero(np.diff(at)):
            s = slice(at[b], at[b + 1])
            rows.append((int(ranges[b]), int(b), g, encode(u[s]), bits(asked[s]), bits(count[s] > 1)))
        return pa.Table.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(_PARTS)], schema=_PARTS)

    def hit(part: pa.Table) -> pa.Table:
        lists = [decode(x) for x in part.column("hashes").to_pylist()]
        many = [v[unbits(x, len(v))] for v, x in zip(lists, part.column("many").to_pylist(), strict=True)]
        s = np.sort(np.concatenate(lists))
        twice = np.unique(np.concatenate([s[1:][s[1:] == s[:-1]], *many]))
        rows, b = [], part.column("b")[0].as_py()
        for g, v, x in zip(part.column("g").to_pylist(), lists, part.column("more").to_pylist(), strict=True):
            blocks = v[unbits(x, len(v))]
            hot = np.isin(blocks, twice, assume_unique=True)
            if hot.any():
                rows.append((g, 1, b, bits(hot)))
        return pa.Table.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(_ANSWERS)], schema=_ANSWERS)

    def extend(group: pa.Table, answers: pa.Table) -> pa.Table:
        rows = []
        if len(group) and len(answers):
            g, own = group.column("g")[0].as_py(), _Group(group.column("text"), width)
            _, h, k, new = own.candidates(_hits(own, _by_step(answers)[0], n_ranges))
            first = np.flatnonzero(new)
            count = np.diff(np.append(first, len(h)))
            h, k = h[first], k[first]
            at = cut_points(h, edges(n_ranges, 64))
            for b in np.flatnonzero(np.diff(at)):
                s = slice(at[b], at[b + 1])
                rows.append((int(ranges[b]), int(b), g, encode(h[s]), k[s].tobytes(), bits(count[s] > 1)))
        return pa.Table.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(_PARTS)], schema=_PARTS)

    def meet(part: pa.Table) -> pa.Table:
        lists = [decode(x) for x in part.column("hashes").to_pylist()]
        sizes = [len(v) for v in lists]
        h = np.concatenate(lists)
        k = np.concatenate([np.frombuffer(x, np.uint32) for x in part.column("more").to_pylist()])
        twice = np.concatenate([unbits(x, n) for x, n in zip(part.column("many").to_pylist(), sizes, strict=True)])
        order = np.lexsort((k, h))
        same = (h[order][1:] == h[order][:-1]) & (k[order][1:] == k[order][:-1])
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        rows, b, at = [], part.column("b")[0].as_py(), np.cumsum([0, *sizes])
        for i, g in enumerate(part.column("g").to_pylist()):
            own = twice[at[i] : at[i + 1]]
            if own.any():
                rows.append((g, 2, b, bits(own)))
        return pa.Table.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(_ANSWERS)], schema=_ANSWERS)

    def remove(group: pa.Table, answers: pa.Table) -> pa.Table:
        own = _Group(group.column("text"), width)
        gone = np.zeros(len(own.at) + 1, np.int64)
        one, two = _by_step(answers)
        if two:
            starts, h, _, new = own.candidates(_hits(own, one, n_ranges))
            which = np.cumsum(new) - 1
            repeated = starts[_answered(h[new], edges(n_ranges, 64), two)[which]]
            np.add.at(gone, repeated, 1)
            np.add.at(gone, repeated + width, -1)
        gone = np.cumsum(gone)[:-1] > 0
        first, kept, removed = own.words.first, [], np.zeros(len(group), np.int64)
        for d, text in enumerate(group.column("text").cast(pa.large_binary()).to_pylist()):
            words, out = (text or b"").split(), gone[first[d] : first[d + 1]]
            removed[d] = out.sum()
            kept.append(b" ".join(compress(words, ~out) if removed[d] else words).decode())
        return pa.Table.from_arrays([group.column("doc_id"), pa.array(own.words.counts), pa.array(removed), pa.array(kept, pa.string())], ["doc_id", "n_words", "n_removed", "kept"])

    hits = dealt.groupBy("g").applyInArrow(probe, _PARTS_SQL).groupBy("r").applyInArrow(hit, _ANSWERS_SQL)
    found = dealt.groupBy("g").cogroup(hits.groupBy("g")).applyInArrow(extend, _PARTS_SQL).groupBy("r").applyInArrow(meet, _ANSWERS_SQL)
    answers = hits.unionByName(found)
    return dealt.groupBy("g").cogroup(answers.groupBy("g")).applyInArrow(remove, f"doc_id {id_type}, n_words long, n_removed long, kept string")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mark_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


ORACLE = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT doc_id, unnest(range(1, len(ws) - 33)) AS p, ws FROM w WHERE len(ws) >= 35),
h AS (SELECT doc_id, p, array_to_string(ws[p : p + 34], ' ') AS win FROM s),
r AS (SELECT doc_id, p FROM (SELECT doc_id, p, count(*) OVER (PARTITION BY win) AS n FROM h) WHERE n > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(p, p + 35)) AS p FROM r),
each AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS p FROM w WHERE len(ws) > 0),
kept AS (
  SELECT e.doc_id, count(*) FILTER (g.p IS NOT NULL) AS n_removed, string_agg(word, ' ' ORDER BY e.p) FILTER (g.p IS NULL) AS kept
  FROM each e LEFT JOIN gone g ON e.doc_id = g.doc_id AND e.p = g.p GROUP BY e.doc_id)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN kept ON w.doc_id = kept.doc_id
"""
