"""Merkle manifest of a dataset: one tree a group, the groups' roots under one root, and a proof for every row.

A leaf digests its row's fields; per tree the leaves are ranked, and every node is labelled by its level and the interval
of leaf ranks that it covers. Levels go in bands of ``BAND``: the nodes of a band that lie under one node of the band's
top are a block, which a containment join on (tree, band, interval) hands its ancestors' part of the proof. Inside a
block intervals say all: a node's ancestor is the one whose interval contains it, its siblings are what is left of the
parent's interval without the node's own.

Blocks have ``fan ** BAND`` nodes at most, whatever the tables' size, so no tree and no group meets in one task. Digests
of a block's top are made going up (a band a round), proofs and folds going down; a leaf takes part in two shuffles of
some hundred bytes, its text in none.
"""

from __future__ import annotations

import hashlib
from functools import reduce
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import checkpointed, packed, partitions, table

#: Children of a node, and levels of a band.
FAN, BAND = 2, 9


def H(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_digest(fields: list[Column]) -> Column:
    """SHA-256 over every field as ``-`` if null, else its UTF-8 byte count, ``:`` and itself."""
    as_text = [f.cast("string") for f in fields]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(f).cast("string"), F.lit(":"), f), F.lit("-")) for f in as_text]), 256)


def ranked(rows: DataFrame, tree: str, order: list[str]) -> DataFrame:
    """``rows`` with ``rank``, from 0 without gaps by ``order`` within ``tree``, and ``n``, the tree's rows.

    Ranges of (tree, order) are dealt out and sorted; a row's place in its range is told by its id there, so that no
    tree needs a window of its own. The offsets are one row a partition and tree.
    """
    by = [F.col(c).asc_nulls_first() for c in (tree, *order)]
    sorted_rows = rows.repartitionByRange(partitions(rows.sparkSession), *by).sortWithinPartitions(*by).withColumn("_m", F.monotonically_increasing_id())
    placed = checkpointed(sorted_rows.withColumn("_p", F.shiftright("_m", 33)))
    parts = placed.groupBy(F.col(tree).alias("_tree"), "_p").agg(F.count("*").alias("_c"), F.min("_m").alias("_first"))
    w = Window.partitionBy("_tree")
    offsets = parts.select("_tree", "_p", "_first", F.coalesce(F.sum("_c").over(w.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"), F.sum("_c").over(w).alias("n"))
    out = placed.join(offsets, placed[tree].eqNullSafe(offsets["_tree"]) & (placed["_p"] == offsets["_p"]))
    return out.select(*[placed[c] for c in rows.columns], (F.col("_before") + F.col("_m") - F.col("_first")).alias("rank"), "n")


def levels_of(n: int, fan: int) -> int:
    """Levels above the leaves until one node remains."""
    k = 0
    while n > 1:
        n, k = -(-n // fan), k + 1
    return k


def intervals(lo: int, hi: int, width: int, fan: int, height: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Labels of a block over the leaf ranks ``lo .. hi``: each level's nodes' first and last covered rank, ``width`` at the foot."""
    out = []
    for level in range(height + 1):
        first = np.arange(lo, hi + 1, width * fan**level)
        out.append((first, np.minimum(first + width * fan**level - 1, hi)))
    return out


def build(labels: list[tuple[np.ndarray, np.ndarray]], foot: list[str]) -> list[list[str]]:
    """Digests of every node, level by level: a parent digests the nodes that its interval contains, from left to right."""
    digests = [foot]
    for (first, _), (lo, hi) in zip(labels, labels[1:]):
        start, stop = np.searchsorted(first, lo), np.searchsorted(first, hi, "right")
        digests.append([H(*digests[-1][i:j]) for i, j in zip(start.tolist(), stop.tolist())])
    return digests


def siblings(labels: list[tuple[np.ndarray, np.ndarray]], digests: list[list[str]], ranks: np.ndarray) -> list[list[tuple[str, str]]]:
    """For every leaf rank and level below the top: the digests left and right of its ancestor within the parent's interval.

    The ancestor of a level is the node whose interval contains the rank. The parent's interval without the node's own
    is two intervals; the nodes in them are the siblings.
    """
    levels = []
    for (first, last), upper, digest in zip(labels, labels[1:], digests):
        parent = np.searchsorted(upper[0], first, "right") - 1
        before, after = np.searchsorted(first, upper[0][parent]).tolist(), np.searchsorted(last, upper[1][parent], "right").tolist()
        beside = [("".join(digest[i:k]), "".join(digest[k + 1 : j])) for k, (i, j) in enumerate(zip(before, after, strict=True))]
        levels.append([beside[k] for k in (np.searchsorted(first, ranks, "right") - 1).tolist()])
    return [list(x) for x in zip(*levels)] if levels else [[] for _ in ranks]


class _Block:
    """The nodes under one node of a band's top, of one tree; ``rank`` is their place in level ``level``."""

    def __init__(self, t: pa.Table, level: int, fan: int, band: int):
        self.t = t.sort_by("rank")
        place = self.t["rank"].to_numpy()
        if not len(place):  # a path that nothing is under, of an empty table
            self.labels, self.digests, self.ranks = [], [], place
            return
        n = self.t["n"][0].as_py()
        width, height = fan**level, max(0, min(band, levels_of(n, fan) - level))
        self.labels = intervals(int(place[0]) * width, min((int(place[-1]) + 1) * width, n) - 1, width, fan, height)
        self.digests = build(self.labels, self.t["digest"].to_pylist())
        self.ranks = place * width

    def paths(self, above: pa.Table) -> list[list[tuple[str, str]]]:
        upper = [(x["l"], x["r"]) for x in above["path"][0].as_py()] if above.num_rows else []
        return [own + upper for own in siblings(self.labels, self.digests, self.ranks)]


def _by_block(nodes: DataFrame, fan: int, band: int):
    return nodes.withColumn("block", F.floor(F.col("rank") / F.lit(fan**band)).cast("long")).groupBy("tree", "block")


def _beside(nodes: DataFrame, above: DataFrame, fan: int, band: int):
    """Each block together with the row of ``above`` (by ``tree`` and ``rank``, the block's place) that covers its interval."""
    return _by_block(nodes, fan, band).cogroup(above.withColumnRenamed("rank", "block").groupBy("tree", "block"))


def tops(nodes: DataFrame, fan: int, band: int, level: int) -> DataFrame:
    """The next band's foot: ``tree``, ``rank`` (the block), ``n`` (the tree's leaves) and the digest of each block's top."""

    def up(t: pa.Table) -> pa.Table:
        top = _Block(t, level, fan, band).digests[-1][0]
        return pa.table({"tree": t["tree"].slice(0, 1), "rank": t["block"].slice(0, 1), "n": t["n"].slice(0, 1), "digest": pa.array([top])})

    kind = nodes.schema["tree"].dataType.simpleString()
    return _by_block(nodes.select("tree", "rank", "n", "digest"), fan, band).applyInArrow(up, f"tree {kind}, rank long, n long, digest string")


PATH = "array<struct<l:string,r:string>>"
_PATH = pa.list_(pa.struct([("l", pa.string()), ("r", pa.string())]))


def proofs(nodes: DataFrame, above: DataFrame, fan: int, band: int, level: int, carried: dict[str, str], inherited: dict[str, str]) -> DataFrame:
    """``tree``, ``rank``, ``path``: the (left, right) siblings of each of ``nodes``, from its level to the root.

    ``carried`` columns (with their types) come from the node, ``inherited`` ones from its ancestor in ``above``.
    """

    def down(t: pa.Table, top: pa.Table) -> pa.Table:
        block = _Block(t, level, fan, band)
        paths = [[{"l": a, "r": b} for a, b in path] for path in block.paths(top)]
        more = {c: pa.array([top[c][0].as_py()] * len(paths), pa.string()) for c in inherited}
        return pa.table({"tree": block.t["tree"], "rank": block.t["rank"], **{c: block.t[c] for c in carried}, **more, "path": pa.array(paths, _PATH)})

    types = "".join(f"{c} {kind}, " for c, kind in (carried | inherited).items())
    schema = f"tree {nodes.schema['tree'].dataType.simpleString()}, rank long, {types}path {PATH}"
    kept = nodes.select("tree", "rank", "n", *dict.fromkeys(["digest", *carried]))
    return _beside(kept, above.select("tree", "rank", "path", *inherited), fan, band).applyInArrow(down, schema)


def verified(leaves: DataFrame, above: DataFrame, fan: int, band: int, id_type: str) -> DataFrame:
    """Each leaf with its trees' roots, all its siblings digested, and what its ``claim`` folds to through them."""

    def check(t: pa.Table, top: pa.Table) -> pa.Table:
        block = _Block(t, 0, fan, band)
        proof, folded = [], []
        for path, node in zip(block.paths(top), block.t["claim"].to_pylist(), strict=True):
            proof.append(H(*[x for pair in path for x in pair]))
            for left, right in path:
                node = H(left, node, right)
            folded.append(node)
        roots = {c: pa.array([top[c][0].as_py()] * len(proof), pa.string()) for c in ("subroot", "root")}
        return pa.table({"doc_id": block.t["doc_id"], "leaf": block.t["digest"], **roots, "proof_sha256": pa.array(proof, pa.string()), "folded_root": pa.array(folded, pa.string())})

    kept = leaves.select("tree", "rank", "n", "digest", "doc_id", "claim")
    return _beside(kept, above.select("tree", "rank", "path", "subroot", "root"), fan, band).applyInArrow(check, f"doc_id {id_type}, leaf string, subroot string, root string, proof_sha256 string, folded_root string")


def climb(leaves: DataFrame, fan: int, band: int) -> tuple[list[DataFrame], DataFrame]:
    """Nodes at the foot of every band, lowest first, and ``tree``, ``digest`` of each tree's root."""
    most = leaves.agg(F.max("n")).first()[0] or 0
    feet, level = [leaves], 0
    while True:
        top = checkpointed(tops(feet[-1], fan, band, level))
        level += band
        if levels_of(most, fan) <= level:
            return feet, top.select("tree", "digest")
        feet.append(top)


def node_table(leaves: DataFrame, fan: int = FAN, band: int = BAND) -> DataFrame:
    """All nodes of the trees over ``leaves`` (``tree rank n digest``): ``tree``, ``level``, ``lo`` and ``hi`` (leaf ranks), ``digest``."""
    feet, _ = climb(leaves, fan, band)
    kind = leaves.schema["tree"].dataType.simpleString()

    def of(level: int):
        def emit(t: pa.Table) -> pa.Table:
            block = _Block(t, level, fan, band)
            levels = [(level + k, *labels, digest) for k, (labels, digest) in enumerate(zip(block.labels, block.digests, strict=True)) if k or not level]
            sizes = [len(x[3]) for x in levels]
            return pa.table({
                "tree": pa.array([t["tree"][0].as_py()] * sum(sizes), t.schema.field("tree").type),
                "level": pa.array([x[0] for x, n in zip(levels, sizes, strict=True) for _ in range(n)], pa.int32()),
                "lo": pa.array([int(v) for x in levels for v in x[1]], pa.int64()),
                "hi": pa.array([int(v) for x in levels for v in x[2]], pa.int64()),
                "digest": pa.array([d for x in levels for d in x[3]], pa.string()),
            })

        return emit

    parts = [_by_block(foot.select("tree", "rank", "n", "digest"), fan, band).applyInArrow(of(i * band), f"tree {kind}, level int, lo long, hi long, digest string") for i, foot in enumerate(feet)]
    return reduce(DataFrame.unionByName, parts)


def leaves_of(rows: DataFrame, fields: list[str], tree: str, order: str, claims: dict[str, Column] | None = None) -> DataFrame:
    """``tree``, ``doc_id``, ``digest``, ``claim``, ``rank``, ``n`` of every row; ``claim`` is the digest with the claimed fields."""
    row = F.col("row")
    claims, leaf, changed = claims or {}, leaf_digest([row[f] for f in fields]), F.lit(False)
    for f, claim in claims.items():
        changed = changed | ~claim.eqNullSafe(row[f])
    claimed = F.when(changed, leaf_digest([claims.get(f, row[f]) for f in fields])) if claims else F.lit(None).cast("string")
    made = packed(rows.select(*dict.fromkeys([*fields, tree, order]))).select(row[tree].alias("tree"), row[order].alias("doc_id"), leaf.alias("digest"), claimed.alias("claim"))
    # Written out: the texts are digested once. The salt splits rows that are equal otherwise, so that no range holds them all.
    made = checkpointed(made.withColumn("claim", F.coalesce("claim", "digest")).withColumn("_salt", F.monotonically_increasing_id()))
    return ranked(made, "tree", ["doc_id", "digest", "_salt"]).drop("_salt")


def manifest(rows: DataFrame, fields: list[str], tree: str = "lang", order: str = "doc_id", claims: dict[str, Column] | None = None, fan: int = FAN, band: int = BAND) -> DataFrame:
    """One row per row: ``doc_id`` (the order column), ``leaf``, ``subroot``, ``root``, ``proof_sha256``, ``folded_root``, ``verified``.

    Trees are the values of ``tree`` (null is one, the first), their leaves ascend by ``order`` (null first), equal ones
    by digest; equal rows are leaves of their own. Nodes have ``fan`` consecutive children, the last of a level fewer; a
    lone leaf is its tree's root. ``claims`` has fields as somebody claims them to be now (columns over ``row``);
    ``folded_root`` is what such a row folds to through its siblings, and ``verified`` says whether that is the root. An
    empty table gives no rows. Columns that aren't named are left alone; texts are digested whole, however long.
    """
    leaves = leaves_of(rows, fields, tree, order, claims)
    feet, subroots = climb(leaves, fan, band)
    # The trees' roots are the leaves of the tree above: one row a tree.
    heads = ranked(subroots.select(F.lit("").alias("tree"), F.col("tree").alias("name"), "digest"), "tree", ["name"])
    head_feet, roots = climb(heads, fan, band)
    root = roots.first()
    above = heads.sparkSession.createDataFrame([("", 0, [])], f"tree string, rank long, path {PATH}")
    for i in range(len(head_feet) - 1, -1, -1):
        above = proofs(head_feet[i], above, fan, band, i * band, {"name": rows.schema[tree].dataType.simpleString(), "digest": "string"} if i == 0 else {}, {})
    above = above.select(F.col("name").alias("tree"), F.lit(0).cast("long").alias("rank"), "path", F.col("digest").alias("subroot"), F.lit(root and root["digest"]).cast("string").alias("root"))
    for i in range(len(feet) - 1, 0, -1):
        above = proofs(feet[i], checkpointed(above), fan, band, i * band, {}, {"subroot": "string", "root": "string"})
    out = verified(feet[0], checkpointed(above), fan, band, rows.schema[order].dataType.simpleString())
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    tampered = F.pmod(F.crc32(F.col("row.doc_id").cast("string").cast("binary")), F.lit(7)) == 0
    claim = F.when(tampered, F.col("row.n_chars") + 1).otherwise(F.col("row.n_chars"))
    return manifest(table(spark, sf_dir, "documents"), ["doc_id", "source", "lang", "n_chars", "text"], claims={"n_chars": claim})


ORACLE = r"""
WITH RECURSIVE l AS (
  SELECT doc_id, lang AS tree,
         row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS rank, count(*) OVER (PARTITION BY lang) AS n,
         coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') AS head,
         n_chars, coalesce(strlen(text) || ':' || text, '-') AS tail
  FROM documents),
leaves AS (
  SELECT doc_id, tree, rank, n, sha256(head || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') || tail) AS leaf,
         sha256(head || coalesce(strlen((n_chars + 1)::VARCHAR) || ':' || (n_chars + 1), '-') || tail) AS more
  FROM l),
nodes AS (
  SELECT tree, 0 AS level, rank AS k, n, leaf AS digest FROM leaves
  UNION ALL
  SELECT tree, level + 1, k // 2, (max(n) + 1) // 2, sha256(string_agg(digest, '' ORDER BY k)) FROM nodes WHERE n > 1 GROUP BY tree, level, k // 2),
subroots AS (SELECT tree, digest, row_number() OVER (ORDER BY tree NULLS FIRST) - 1 AS rank, count(*) OVER () AS n FROM nodes WHERE n = 1),
heads AS (
  SELECT 0 AS level, rank AS k, n, digest FROM subroots
  UNION ALL
  SELECT level + 1, k // 2, (max(n) + 1) // 2, sha256(string_agg(digest, '' ORDER BY k)) FROM heads WHERE n > 1 GROUP BY level, k // 2),
above AS (
  SELECT s.tree, h.level, s.rank // power(2, h.level)::BIGINT AS k, coalesce(b.digest, '') AS beside
  FROM subroots s JOIN heads h ON h.k = s.rank // power(2, h.level)::BIGINT AND h.n > 1
  LEFT JOIN heads b ON b.level = h.level AND b.k = xor(h.k, 1)),
steps AS (
  SELECT l.doc_id, l.tree, l.rank, x.level, x.k, coalesce(b.digest, '') AS beside
  FROM leaves l JOIN nodes x ON x.tree IS NOT DISTINCT FROM l.tree AND x.k = l.rank // power(2, x.level)::BIGINT AND x.n > 1
  LEFT JOIN nodes b ON b.tree IS NOT DISTINCT FROM x.tree AND b.level = x.level AND b.k = xor(x.k, 1)
  UNION ALL
  SELECT l.doc_id, l.tree, l.rank, 1000 + a.level, a.k, a.beside FROM leaves l JOIN above a ON a.tree IS NOT DISTINCT FROM l.tree),
paths AS (
  SELECT tree, rank, sha256(coalesce(string_agg(beside, '' ORDER BY level), '')) AS proof, list({'odd': k % 2, 'beside': beside} ORDER BY level) AS path
  FROM steps GROUP BY tree, rank),
crc AS (
  SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, s: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t
  FROM range(256) AS r(i)),
lanes AS (
  SELECT doc_id, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
         lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8)), 4294967295) AS lane
  FROM (SELECT DISTINCT doc_id FROM documents), crc),
folds AS (
  SELECT l.tree, l.rank, 1 AS i, p.path, CASE WHEN t.lane % 7 = 0 THEN more ELSE leaf END AS digest
  FROM leaves l LEFT JOIN lanes t ON t.doc_id = l.doc_id LEFT JOIN paths p ON p.tree IS NOT DISTINCT FROM l.tree AND p.rank = l.rank
  UNION ALL
  SELECT tree, rank, i + 1, path, sha256(CASE WHEN path[i].odd = 1 THEN path[i].beside || digest ELSE digest || path[i].beside END) FROM folds WHERE i <= len(path))
SELECT l.doc_id, l.leaf, s.digest AS subroot, r.digest AS root, coalesce(p.proof, sha256('')) AS proof_sha256, f.digest AS folded_root, f.digest = r.digest AS verified
FROM leaves l JOIN subroots s ON s.tree IS NOT DISTINCT FROM l.tree JOIN heads r ON r.n = 1
LEFT JOIN paths p ON p.tree IS NOT DISTINCT FROM l.tree AND p.rank = l.rank
JOIN folds f ON f.tree IS NOT DISTINCT FROM l.tree AND f.rank = l.rank AND f.i = coalesce(len(f.path), 0) + 1
"""
