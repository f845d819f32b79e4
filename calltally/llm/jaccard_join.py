"""Exact Jaccard self-join of documents on word shingles, size-aware: subsets for small sets, inverted lists for large.

Two sets of n and m shingles link when 100 * overlap >= 85 * union, which is 185 * overlap >= 85 * (n + m).

Small sets (up to a boundary chosen by cost) enumerate their subsets of the overlap that a link needs: sets that share
one link, others don't. Large sets are met in inverted lists, but only of the shingles of their prefix: in an order
common to all, rare shingles first, a link's two sets share one of their first n - ceil(0.85 n) + 1, at places that
leave room for the overlap. Counting all shingles first is what makes this work: a passage that thousands of documents
hold comes last in their order, and a shingle found once in the corpus needs no list at all.

Links are not expanded to pairs within a group of copies. Texts that are equal are counted once; members of a list are
first held against one pivot of the list and the links' components taken. What is left are the pairs of a list that are
still in different components. Lists with few of them a member are done with by checking those. A longer list is split:
of two sets that link the first k common shingles lie in prefixes longer by k - 1, so its members meet again in lists of
it and one later shingle, with a pivot each, and again in lists of three. So no link between different texts is lost.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD_CLASS, checkpointed, packed, partitions, spread, table
from .components import components
from .rolling import U, Words, cut_points, decode, edges, encode, mix, windows

SHINGLE = 4
PERCENT = 85
#: What a stage of a pipeline takes.
STAGE_SHINGLE, STAGE_PERCENT = 5, 80
TOKEN_BITS = 48  # in the count, where a collision only makes a shingle look more frequent
SET_BITS = 56  # in the exact check of a pair
#: Sets up to this size are considered for enumeration; the cost decides how far it goes.
LARGEST_SMALL = 40
#: What a pair's check costs, in subsets: two sets are fetched and intersected for it, where a subset is one short row.
PAIR_COST = 10
#: Pairs of different components that a list may hold for each of its members before it is split, and shingles that the
#: members of a list share at most: such lists are done with by checking their pairs, however many.
MOST_PAIRS = 4096
MOST_SHARED = 3


def least_overlap(n: int, m: int, percent: int) -> int:
    return -(-percent * (n + m) // (100 + percent))


def partner_sizes(n: int, percent: int) -> range:
    return range(-(-percent * n // 100), 100 * n // percent + 1)


def subset_cost(n: int, percent: int) -> int:
    return sum(comb(n, least_overlap(n, m, percent)) for m in partner_sizes(n, percent) if least_overlap(n, m, percent) <= min(n, m))


def prefix_length(n, percent: int):
    return n - -(-percent * n // 100) + 1


def packed_tokens(h: np.ndarray) -> bytes:
    """A set's shingles in the common order, each by its upper SET_BITS."""
    return np.ascontiguousarray((h >> U(64 - SET_BITS)).view(np.uint8).reshape(-1, 8)[:, : SET_BITS // 8]).tobytes()


def tokens_of(blob: bytes) -> np.ndarray:
    own = np.frombuffer(blob, np.uint8).reshape(-1, SET_BITS // 8)
    out = np.zeros((len(own), 8), np.uint8)
    out[:, : SET_BITS // 8] = own
    return out.view(np.uint64).ravel()


class _Sets:
    """The shingle sets of a group's texts: ``doc`` and ``h``, ordered by both."""

    def __init__(self, texts: pa.ChunkedArray, shingle: int):
        words = Words(texts, lower=True)
        ends = words.last()
        at = np.arange(len(ends))
        doc = np.repeat(np.arange(len(words.counts)), words.counts)
        sums = words.sums()
        full = at[at + shingle <= ends]
        h, d = [windows(sums, full, shingle)], [doc[full]]
        for short in range(1, shingle):  # fewer words: the whole sequence as one
            docs = np.flatnonzero(words.counts == short)
            h.append(windows(sums, words.first[docs], short) ^ U(short))
            d.append(docs)
        h, d = np.concatenate(h), np.concatenate(d)
        order = np.lexsort((h, d))
        h, d = h[order], d[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
        self.h, self.doc = h[new], d[new]
        self.first = np.searchsorted(self.doc, np.arange(len(words.counts) + 1))


_PARTS = pa.schema([("r", pa.int32()), ("b", pa.int32()), ("g", pa.int32()), ("hashes", pa.binary()), ("counts", pa.binary())])
_SETS_SQL = "t1 long, t2 int, least_id {id}, node long, n int, list array<struct<token: long, pos: int>>, tokens binary"


def _own(docs: pa.Table, reps: pa.Table) -> np.ndarray:
    """Rows that stand for their text: one for each text of the whole table."""
    chosen = set(zip(reps.column("doc_id").to_pylist(), reps.column("t1").to_pylist(), reps.column("t2").to_pylist(), strict=True))
    keep = []
    for i, key in enumerate(zip(docs.column("doc_id").to_pylist(), docs.column("t1").to_pylist(), docs.column("t2").to_pylist(), strict=True)):
        if key in chosen:
            chosen.discard(key)
            keep.append(i)
    return np.array(keep, np.int64)


def shingle_sets(docs: DataFrame, shingle: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """One row per different text: its key, smallest id, set (``node``), size, prefix lists, and tokens where needed."""
    spark = docs.sparkSession
    n = partitions(spark)
    n_groups, n_ranges = 4 * n, n
    groups, ranges = spread(spark, n_groups), np.array(spread(spark, n_ranges))
    source = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    id_type = source.schema["doc_id"].dataType.simpleString()
    source = source.withColumns({"g": F.get(F.array(*map(F.lit, groups)), F.pmod(F.xxhash64("doc_id", "text"), F.lit(n_groups)).cast("int")), "t1": F.xxhash64("text"), "t2": F.hash("text")})
    dealt = source.repartition(n, "g")
    reps = source.groupBy("t1", "t2").agg(F.min(F.struct("doc_id", "g")).alias("r"), F.min("doc_id").alias("least_id"))
    reps = checkpointed(reps.select("r.g", F.lit(-1).alias("b"), F.lit(None).cast("binary").alias("blob"), "r.doc_id", "t1", "t2", "least_id"))
    reps = reps.select(*[F.col(c).alias(c) for c in reps.columns])  # a cogroup needs attributes that the other side hasn't

    def count(group: pa.Table, own: pa.Table) -> pa.Table:
        rows = []
        if len(group) and len(own):
            g = group.column("g")[0].as_py()
            sets = _Sets(group.column("text").take(pa.array(_own(group, own))), shingle)
            u, times = np.unique(sets.h >> U(64 - TOKEN_BITS), return_counts=True)
            at, times = cut_points(u, edges(n_ranges, TOKEN_BITS)), np.minimum(times, 65535).astype("<u2")
            for b in np.flatnonzero(np.diff(at)):
                s = slice(at[b], at[b + 1])
                rows.append((int(ranges[b]), int(b), g, encode(u[s]), times[s].view(np.uint8).reshape(-1, 2).T.tobytes()))
        return pa.Table.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(_PARTS)], schema=_PARTS)

    def rank(part: pa.Table) -> pa.Table:
        lists = [decode(x) for x in part.column("hashes").to_pylist()]
        times = [np.ascontiguousarray(np.frombuffer(x, np.uint8).reshape(2, -1).T).view("<u2").ravel() for x in part.column("counts").to_pylist()]
        u, inverse = np.unique(np.concatenate(lists), return_inverse=True)
        df = np.bincount(inverse, np.concatenate(times).astype(np.float64), len(u))
        # Quarter powers of two: frequent enough apart to order by, and a byte.
        rank = np.where(df > 1, np.minimum(255, np.ceil(4 * np.log2(np.maximum(df, 1)))), 0).astype(np.uint8)[inverse]
        out, b, at = [], part.column("b")[0].as_py(), np.cumsum([0, *map(len, lists)])
        for i, g in enumerate(part.column("g").to_pylist()):
            own = rank[at[i] : at[i + 1]]
            if own.any():
                out.append((g, b, own.tobytes()))
        return pa.table({"g": pa.array([r[0] for r in out], pa.int32()), "b": pa.array([r[1] for r in out], pa.int32()), "blob": pa.array([r[2] for r in out], pa.binary())})

    def prefix(group: pa.Table, told: pa.Table) -> pa.Table:
        names = ["t1", "t2", "least_id", "node", "n", "list", "tokens"]
        types = [pa.int64(), pa.int32(), told.column("least_id").type, pa.int64(), pa.int32(), pa.list_(pa.struct([("token", pa.int64()), ("pos", pa.int32())])), pa.binary()]
        cols: list[list] = [[] for _ in names]
        is_rep = np.array(told.column("b").to_pylist()) == -1
        if len(group) and is_rep.any():
            own = told.filter(pa.array(is_rep))
            keep = pa.array(_own(group, own))
            least = dict(zip(zip(own.column("t1").to_pylist(), own.column("t2").to_pylist(), strict=True), own.column("least_id").to_pylist(), strict=True))
            mine = group.take(keep)
            sets = _Sets(mine.column("text"), shingle)
            u, inverse = np.unique(sets.h >> U(64 - TOKEN_BITS), return_inverse=True)
            ranks, at = np.zeros(len(u), np.uint8), cut_points(u, edges(n_ranges, TOKEN_BITS))
            for b, blob in zip(told.column("b").to_pylist(), told.column("blob").to_pylist(), strict=True):
                if b >= 0:
                    ranks[at[b] : at[b + 1]] = np.frombuffer(blob, np.uint8)
            ranks = ranks[inverse]
            for d, (t1, t2) in enumerate(zip(mine.column("t1").to_pylist(), mine.column("t2").to_pylist(), strict=True)):
                h, r = sets.h[sets.first[d] : sets.first[d + 1]], ranks[sets.first[d] : sets.first[d + 1]]
                n, lists = len(h), []
                p = prefix_length(n, percent)
                single = int((r == 0).sum())
                if n and single < p:
                    order = np.lexsort((h, r))[single:p]
                    lists = [{"token": t, "pos": single + k} for k, t in enumerate(h[order].view(np.int64).tolist())]
                node = int.from_bytes(hashlib.blake2b(h.tobytes(), digest_size=8).digest(), "little", signed=True) if n else None
                tokens = packed_tokens(h[np.lexsort((h, r))]) if lists else None  # no list: too many shingles found once to link
                for c, v in zip(cols, (t1, t2, least[(t1, t2)], node, n, lists, tokens), strict=True):
                    c.append(v)
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names)

    parts = dealt.groupBy("g").cogroup(reps.groupBy("g")).applyInArrow(count, "r int, b int, g int, hashes binary, counts binary")
    told = parts.groupBy("r").applyInArrow(rank, "g int, b int, blob binary")
    told = told.select("g", "b", "blob", F.lit(None).cast(id_type).alias("doc_id"), F.lit(None).cast("long").alias("t1"), F.lit(None).cast("int").alias("t2"), F.lit(None).cast(id_type).alias("least_id")).union(reps)
    return checkpointed(dealt.groupBy("g").cogroup(told.groupBy("g")).applyInArrow(prefix, _SETS_SQL.format(id=id_type)))


def boundary(sets: DataFrame, lists: DataFrame, percent: int) -> int:
    """The largest size up to which enumerating subsets costs no more than scanning lists, over the sets there are.

    In a list a set costs a row and, unless it is alone there, the check against the list's pivot.
    """
    sizes = {r["n"]: r["count"] for r in sets.where(F.col("n").between(1, LARGEST_SMALL)).groupBy("n").count().collect()}
    met = lists.groupBy("token").count().agg(F.sum(F.when(F.col("count") > 1, F.col("count"))) / F.sum("count")).first()[0] or 0.0
    cost, best, at = 0.0, 0.0, 0
    for n in range(1, LARGEST_SMALL + 1):
        cost += sizes.get(n, 0) * (subset_cost(n, percent) - prefix_length(n, percent) * (1 + PAIR_COST * met))
        if cost <= best:
            best, at = cost, n
    return at


def _subset_links(sets: DataFrame, most: int, percent: int) -> DataFrame:
    """Stars of the small sets that share a subset as large as their link needs."""

    def enumerate_subsets(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            keys, nodes, large = [], [], []
            for node, n, blob in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                tokens = np.sort(tokens_of(blob))
                for m in partner_sizes(n, percent):
                    c = least_overlap(n, m, percent)
                    if m > most or c > min(n, m):
                        continue
                    lo, hi = min(n, m), max(n, m)
                    for s in combinations(range(n), c):
                        keys.append(hashlib.blake2b(tokens[list(s)].tobytes() + bytes([lo, hi]), digest_size=16).digest())
                        nodes.append(node)
                        large.append(n == hi)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(nodes, pa.int64()), pa.array(large, pa.bool_())], ["key", "node", "large"])

    held = sets.where(F.col("n").between(2, most) & F.col("tokens").isNotNull()).select("node", "n", "tokens").dropDuplicates(["node"])
    subsets = checkpointed(held.mapInArrow(enumerate_subsets, "key binary, node long, large boolean"))
    stars = subsets.groupBy("key").agg(F.min(F.when(F.col("large"), F.col("node"))).alias("l"), F.min(F.when(~F.col("large"), F.col("node"))).alias("s"), F.count("*").alias("k"))
    stars = stars.where("k > 1").select("key", F.coalesce("s", "l").alias("pivot"), F.coalesce("l", "s").alias("other"))
    # Small ones link to a large one and large ones to a small one; sets of one size to the least of them.
    return subsets.join(stars, "key").select(F.col("node").alias("a"), F.when(F.col("large"), F.col("pivot")).otherwise(F.col("other")).alias("b")).where("a <> b").distinct()


def _may_link(percent: int, least_large: int, before: int = 0) -> Column:
    """Sizes and places of a list's (last) shingle in sets a and b that allow a link, if they have so many in common before it."""
    n, m, i, j = (F.col(c) for c in ("n_a", "n_b", "pos_a", "pos_b"))
    return (
        (100 * F.least(n, m) >= percent * F.greatest(n, m))
        & (F.greatest(n, m) > least_large)
        & ((100 + percent) * (before + F.least(n - i, m - j)) >= percent * (n + m))
    )


def _verified(pairs: DataFrame, tokens: DataFrame, percent: int) -> DataFrame:
    """The rows of ``pairs`` (columns a, b and others) whose sets link, by their exact overlap."""

    def check(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            links = np.zeros(b.num_rows, bool)
            held: dict[bytes, np.ndarray] = {}
            for k, (x, y) in enumerate(zip(b.column("x").to_pylist(), b.column("y").to_pylist(), strict=True)):
                if y not in held:
                    held = {y: tokens_of(y)}
                u, v = tokens_of(x), held[y]
                overlap = len(np.intersect1d(u, v, assume_unique=True))
                links[k] = (100 + percent) * overlap >= percent * (len(u) + len(v))
            yield b.drop_columns(["x", "y"]).filter(pa.array(links))

    with_x = pairs.join(tokens.select(F.col("node").alias("a"), F.col("tokens").alias("x")), "a")
    both = with_x.join(tokens.select(F.col("node").alias("b"), F.col("tokens").alias("y")), "b").select(*pairs.columns, "x", "y")
    return both.mapInArrow(check, pairs.schema)


def _side(rows: DataFrame, s: str) -> DataFrame:
    return rows.select(F.col("key").alias(f"key_{s}"), F.col("node").alias(s), F.col("n").alias(f"n_{s}"), F.col("pos").alias(f"pos_{s}"), F.col("c").alias(f"c_{s}"))


def _split_lists(rows: DataFrame, tokens: DataFrame, level: int, percent: int) -> DataFrame:
    """Members of lists again in lists of one more shingle, later in the common order, within prefixes longer by one."""

    def expand(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            own = [b.column(k).to_pylist() for k in ("key", "n", "pos", "tokens")]
            which, more, at = [], [], []
            for i, (key, n, pos, blob) in enumerate(zip(*own, strict=True)):
                later = np.arange(pos + 1, min(n, prefix_length(n, percent) + level - 1))
                which.append(np.full(len(later), i))
                more.append(mix(tokens_of(blob)[later] ^ mix(np.array([key], np.int64).view(U))).view(np.int64))
                at.append(later)
            if which:
                take = pa.array(np.concatenate(which))
                new = [pa.array(np.concatenate(more)), b.column("node").take(take), b.column("n").take(take), pa.array(np.concatenate(at).astype(np.int32)), b.column("c").take(take)]
                yield pa.RecordBatch.from_arrays(new, ["key", "node", "n", "pos", "c"])

    return rows.join(tokens, "node").select("key", "node", "n", "pos", "c", "tokens").mapInArrow(expand, "key long, node long, n int, pos int, c long")


def _links_apart(rows: DataFrame, tokens: DataFrame, percent: int, most: int) -> DataFrame:
    """Links (``a``, ``b``) between the components ``c`` of the members of lists (``key``, ``node``, ``n``, ``pos``, ``c``)."""
    found = None
    level = 1
    while True:
        each = rows.groupBy("key", "c").agg(F.count("*").alias("k"))
        lists = each.groupBy("key").agg(F.sum("k").alias("k"), F.sum(F.col("k") * F.col("k")).alias("same"), F.max(F.struct("k", "c")).alias("m"), F.count("*").alias("parts"))
        lists = checkpointed(lists.where("parts > 1").select("key", (F.lit(level < MOST_SHARED) & (F.col("k") * F.col("k") - F.col("same") > 2 * MOST_PAIRS * F.col("k"))).alias("long"), F.col("m.c").alias("main")))
        rows = checkpointed(rows.join(lists, "key"))
        # Few pairs: those outside the largest component against all.
        short = rows.where("NOT long")
        pairs = _side(short.where("c <> main"), "a").join(_side(short, "b"), (F.col("key_a") == F.col("key_b")) & (F.col("c_a") != F.col("c_b")) & _may_link(percent, most, level - 1))
        long = rows.where("long").drop("long", "main")
        more = level < MOST_SHARED and not long.isEmpty()
        if more:
            pivots = long.groupBy("key").agg(F.min(F.struct("pos", "node", "n", "c")).alias("p")).select("key", "p.*")
            pairs = pairs.unionByName(_side(long, "a").join(_side(pivots, "b"), (F.col("key_a") == F.col("key_b")) & (F.col("c_a") != F.col("c_b")) & _may_link(percent, most, level - 1)))
        ordered = F.when(F.col("a") < F.col("b"), F.struct("a", "b", "c_a", "c_b")).otherwise(F.struct(F.col("b").alias("a"), F.col("a").alias("b"), F.col("c_b").alias("c_a"), F.col("c_a").alias("c_b")))
        linked = _verified(pairs.select(ordered.alias("p")).select("p.*").distinct(), tokens, percent).select(F.col("c_a").alias("a"), F.col("c_b").alias("b")).distinct()
        found = checkpointed(linked if found is None else found.unionByName(linked).distinct())
        if not more:
            return found
        level += 1
        near = components(found).select(F.col("node").alias("c"), "label")
        rows = long.join(near, "c", "left").withColumn("c", F.coalesce("label", "c")).drop("label")
        rows = _split_lists(rows, tokens, level, percent)


def link_documents(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``t1`` and ``t2`` (key of the text), ``n_shingles``, ``component_id`` and ``group`` of every row of ``docs``.

    ``group`` numbers the components (null: a text without shingles), ``component_id`` is the smallest id that links
    reach. A null text and one without words have no shingles and link with nothing, not even with each other. Equal
    texts link (rows with equal ids too). Null ids are passed over for the smallest; a component of null ids alone has a
    null id.
    """
    sets = shingle_sets(docs, shingle, percent, id_col, text_col)
    lists = sets.where(F.size("list") > 0).select("node", "n", F.explode("list").alias("e")).select("node", "n", "e.token", "e.pos").distinct()
    lists = checkpointed(lists)
    most = boundary(sets, lists, percent)
    tokens = sets.where(F.col("tokens").isNotNull()).select("node", "tokens").dropDuplicates(["node"])
    lists = lists.where(F.col("n") >= -(-percent * (most + 1) // 100))

    # One pivot for each list: the set that has most room left, so that near copies meet at their common source.
    pivots = lists.groupBy("token").agg(F.min(F.struct("pos", "node", "n")).alias("p"), F.count("*").alias("k")).where("k > 1")
    pivots = pivots.select("token", F.col("p.node").alias("b"), F.col("p.n").alias("n_b"), F.col("p.pos").alias("pos_b"))
    stars = lists.select("token", F.col("node").alias("a"), F.col("n").alias("n_a"), F.col("pos").alias("pos_a")).join(pivots, "token")
    stars = stars.where((F.col("a") != F.col("b")) & _may_link(percent, most)).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    first = _subset_links(sets, most, percent).unionByName(stars).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    near = components(_verified(first, tokens, percent))

    # Members of a list that are still in different components.
    told = lists.join(near, "node", "left").select(F.col("token").alias("key"), "node", "n", "pos", F.coalesce("label", "node").alias("c"))
    linked = _links_apart(checkpointed(told), tokens, percent, most)
    far = components(linked).select(F.col("node").alias("c"), F.col("label").alias("far"))

    nodes = sets.select("t1", "t2", "node", "n", "least_id").join(near, "node", "left").withColumn("c", F.coalesce("label", "node")).drop("label").join(far, "c", "left")
    nodes = nodes.select("t1", "t2", "n", "least_id", F.coalesce("far", "c").alias("c"))
    least = nodes.where(F.col("c").isNotNull()).groupBy("c").agg(F.min("least_id").alias("component_id"))
    nodes = nodes.join(least, "c", "left").select("t1", "t2", "n", "component_id", F.col("c").alias("group"))
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.xxhash64(F.col(f"`{text_col}`")).alias("t1"), F.hash(F.col(f"`{text_col}`")).alias("t2"))
    out = rows.join(nodes, ["t1", "t2"], "left")
    return out.select("doc_id", "t1", "t2", F.col("n").cast("long").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"), "group")


def keep_one_of_each(docs: DataFrame, shingle: int = STAGE_SHINGLE, percent: int = STAGE_PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with its own columns, without near duplicates: of each component the row with the smallest id stays.

    Of rows with equal ids one stays, by the hash of its text; null ids come last. Texts without shingles all stay.
    """
    linked = checkpointed(link_documents(docs, shingle, percent, id_col, text_col).where(F.col("group").isNotNull()).select("doc_id", "t1", "t2", "group"))
    best = linked.groupBy("group").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "t1", "t2")).alias("m")).select("m.doc_id", "m.t1", "m.t2")
    keep = best.select(F.col("doc_id").alias("_id"), F.col("t1").alias("_t1"), F.col("t2").alias("_t2"))
    row = F.col("row")
    keyed = packed(docs).select("row", row[id_col].alias("_doc"), F.xxhash64(row[text_col]).alias("_a"), F.hash(row[text_col]).alias("_b"), F.coalesce(row[text_col].rlike(WORD_CLASS), F.lit(False)).alias("_full"))
    same = keyed["_doc"].eqNullSafe(keep["_id"]) & (keyed["_a"] == keep["_t1"]) & (keyed["_b"] == keep["_t2"])
    joined = keyed.join(keep.withColumn("_hit", F.lit(True)), same, "left").where(~F.col("_full") | F.col("_hit"))
    # Rows equal in id and text: the first of them.
    nth = F.row_number().over(Window.partitionBy("_doc", "_a", "_b").orderBy("_full"))
    return joined.withColumn("_nth", nth).where(~F.col("_full") | (F.col("_nth") == 1)).select("row.*")


def op9_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_documents(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(ws[p : p + 3], ' ') AS sh
  FROM (SELECT doc_id, ws, unnest(CASE WHEN len(ws) >= 4 THEN range(1, len(ws) - 2) WHEN len(ws) > 0 THEN [1] ELSE [] END) AS p FROM w)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.sh = y.sh AND x.doc_id <> y.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM o JOIN n x ON o.a = x.doc_id JOIN n y ON o.b = y.doc_id WHERE 100 * c >= 85 * (x.n + y.n - c)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN l ON r.b = l.a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, min(reach.b) AS component_id
FROM documents d JOIN reach ON d.doc_id = reach.a LEFT JOIN n ON d.doc_id = n.doc_id GROUP BY d.doc_id, n.n
"""
