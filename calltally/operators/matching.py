"""Vector matching: people on the same problem, earlier solutions, groups of unattributed work."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.columns import norm, valid_embedding

SAME_BAR, CROSS_BAR = 0.40, 0.55
WALLS = ("org", "residency", "client")
SERVE, WARM, WARM_FRACTION = 0.95, 0.80, 0.4


def unit(v: Column) -> Column:
    return F.transform(v, lambda x: x.cast("double") / norm(v))


def _dot(a: str, b: str) -> Column:
    return F.aggregate(F.zip_with(F.col(a), F.col(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def latest_signals(signals: DataFrame) -> DataFrame:
    """One signal for each actor: the latest."""
    w = Window.partitionBy("actor").orderBy(F.desc("ts"), F.desc("event_id"))
    return signals.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


@dataclass(frozen=True)
class Hyperplanes:
    """Random hyperplanes: vectors on the same sides of all ``planes`` of some table share a bucket.

    Two vectors at a cosine of 0.8 share one with a chance of over 0.9, at 0.95 of over 0.999; see ``chance``.
    """

    tables: int = 24
    planes: int = 10
    seed: int = 5

    def chance(self, cosine: float) -> float:
        side = 1 - np.arccos(cosine) / np.pi
        return float(1 - (1 - side**self.planes) ** self.tables)


INDEX = Hyperplanes()


@lru_cache(maxsize=8)
def _normals(index: Hyperplanes, width: int) -> np.ndarray:
    return np.random.default_rng((index.seed, width)).normal(size=(width, index.tables * index.planes))


def signatures(vector: Column, index: Hyperplanes = INDEX) -> Column:
    """The vector's bucket in every table, numbered over all tables; null has none."""

    @F.pandas_udf("array<long>")
    def of(vectors: pd.Series) -> pd.Series:
        weights = 1 << np.arange(index.planes)
        out = []
        for v in vectors:
            if v is None:
                out.append(None)
                continue
            sides = (np.asarray(v, float) @ _normals(index, len(v)) >= 0).reshape(index.tables, index.planes)
            out.append((np.arange(index.tables) << index.planes) + sides @ weights)
        return pd.Series(out)

    return of(vector)


def lsh_candidates(vectors: DataFrame, id_col: str, index: Hyperplanes = INDEX) -> DataFrame:
    """Pairs of ids (a < b) whose vectors share a bucket in some table. An exact check has to follow."""
    keyed = vectors.select(F.col(id_col).alias("id"), F.explode(signatures(F.col("embedding"), index)).alias("k"))
    return keyed.select("k", F.col("id").alias("a")).join(keyed.select("k", F.col("id").alias("b")), "k").where("a < b").select("a", "b").distinct()


def group_of(key: Column, groups: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(groups)).cast("int")


def cells_of(own: Column, groups: int) -> Column:
    """The cells of a row of group ``own``: one for each group, with itself or another; two rows share exactly one that both belong to.

    A cell is numbered 1000 * smaller + larger group. Rows of one group share more cells, but count only in their own.
    """
    return F.transform(F.sequence(F.lit(0), F.lit(groups - 1)), lambda g: (F.least(own, g) * 1000 + F.greatest(own, g)).cast("int"))


#: Vectors of a group, at most about so many; a task holds the two groups of a cell. Rows that meet at once in a cell.
GROUP, STEP = 8192, 256


def groups_of(rows: DataFrame, keys: list[str], most: int = GROUP, least: int = 4) -> int:
    """So many groups that none holds much more than ``most`` rows of one of the ``keys``, 999 at most (see ``cells_of``)."""
    largest = rows.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0
    return min(999, max(least, -(-largest // most)))


def in_cells(rows: DataFrame, dealt_by: str, groups: int) -> DataFrame:
    """Each row in its group's cell with every group; ``lo`` and ``hi`` are a cell's groups, ``grp`` the row's."""
    out = rows.withColumn("grp", group_of(F.col(dealt_by), groups)).withColumn("_cell", F.explode(cells_of(F.col("grp"), groups)))
    return out.withColumns({"lo": F.floor(F.col("_cell") / 1000), "hi": F.col("_cell") % 1000}).drop("_cell")


def units(t: pa.Table) -> np.ndarray:
    """The vectors of ``t``, all of one width, at length one."""
    v = np.asarray(t["embedding"].combine_chunks().flatten().to_numpy(zero_copy_only=False), float).reshape(t.num_rows, -1)
    return v / np.sqrt((v * v).sum(1, keepdims=True))


def codes(*columns: pa.ChunkedArray) -> list[np.ndarray]:
    """Numbers for the values of columns that share them; -1 for null."""
    of = pd.factorize(np.concatenate([c.to_numpy(zero_copy_only=False) for c in columns]))[0]
    return np.split(of, np.cumsum([len(c) for c in columns])[:-1])


def sides(batches: Iterator[pa.RecordBatch], order: str) -> tuple[pa.Table, pa.Table, bool]:
    """The two groups of a cell in order, and whether they are one."""
    t = pa.Table.from_batches(list(batches)).sort_by(order)
    lo, hi, grp = t["lo"][0].as_py(), t["hi"][0].as_py(), t["grp"].to_numpy()
    a = t.filter(pa.array(grp == lo))
    return a, a if lo == hi else t.filter(pa.array(grp == hi)), lo == hi


PAIRS = "x string, y string, sim double, same_objective boolean, solved boolean"


def near_pairs(signals: DataFrame, walls: tuple[str, ...], bar: float, groups: int) -> DataFrame:
    """Pairs of actors behind the same walls at ``bar`` or a rounding below, each once: cells of two groups multiply their vectors."""

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b, one = sides(batches, "actor")
        if not (a.num_rows and b.num_rows):
            return
        u, v = units(a), units(b)
        objectives, labels = codes(a["objective_id"], b["objective_id"]), codes(a["label"], b["label"])
        solved = [t["is_solved"].to_numpy(zero_copy_only=False) for t in (a, b)]
        for i in range(0, len(u), STEP):
            first = i if one else 0  # of one group only those that come after
            sims = u[i : i + STEP] @ v[first:].T
            if one:
                sims[np.tril_indices(len(sims), 0, sims.shape[1])] = -2
            x, y = np.nonzero(sims >= bar - 1e-6)
            sim, x, y = sims[x, y], x + i, y + first
            both = (objectives[0][x] >= 0) & (objectives[1][y] >= 0)
            same = np.where(both, objectives[0][x] == objectives[1][y], (labels[0][x] >= 0) & (labels[0][x] == labels[1][y]))
            if len(x):
                yield pa.RecordBatch.from_pydict({"x": a["actor"].combine_chunks().take(pa.array(x)), "y": b["actor"].combine_chunks().take(pa.array(y)), "sim": sim, "same_objective": same, "solved": (solved[0][x] | solved[1][y]).astype(bool)})

    s = signals.where("actor IS NOT NULL").select(
        *walls, F.size("embedding").alias("width"), F.col("actor").cast("string").alias("actor"), F.col("objective_id").cast("string").alias("objective_id"), F.col("label").cast("string").alias("label"),
        F.coalesce("is_solved", F.lit(False)).alias("is_solved"), F.col("embedding").cast("array<double>").alias("embedding"),
    )
    return in_cells(s, "actor", groups).groupBy(*walls, "width", "lo", "hi").applyInArrow(meet, PAIRS)


def broker_matches(signals: DataFrame, walls: tuple[str, ...] = WALLS, same_bar: float = SAME_BAR, cross_bar: float = CROSS_BAR, groups: int | None = None, index: Hyperplanes | None = None) -> DataFrame:
    """Pairs of actors close enough, within the walls (null only with null), once each (a < b).

    The bar is the lower one for the same objective (ids if both are known, else labels) or if either side solved it. A
    wall's actors are dealt to ``groups``, by default so many that a group has about ``GROUP`` of them; every two groups
    are a cell whose vectors one task multiplies, so a cell's size stays as it is however many actors a wall holds.
    With ``index`` only actors that share a bucket meet: fewer pairs, and close ones are missed by ``index.chance``.
    """
    s = latest_signals(signals).where(valid_embedding(F.col("embedding")))
    if index is None:
        pairs = near_pairs(s, walls, min(same_bar, cross_bar), groups or groups_of(signals, list(walls)))
        same, solved, a, b = F.col("same_objective"), F.col("solved"), F.least("x", "y"), F.greatest("x", "y")
        pairs = pairs.withColumn("sim", F.round("sim", 6))
    else:
        s = s.withColumn("u", unit(F.col("embedding"))).withColumn("_cell", F.explode(signatures(F.col("embedding"), index)))
        side = lambda x: s.select(*[F.col(c).alias(f"{c}_{x}") for c in (*walls, "actor", "objective_id", "label", "is_solved", "u", "_cell")])
        on = (F.col("actor_a") < F.col("actor_b")) & (F.col("_cell_a") == F.col("_cell_b"))
        for w in walls:
            on = on & F.col(f"{w}_a").eqNullSafe(F.col(f"{w}_b"))
        pairs = side("a").join(side("b"), on).withColumn("sim", F.round(_dot("u_a", "u_b"), 6))
        same = F.coalesce(F.when(F.col("objective_id_a").isNotNull() & F.col("objective_id_b").isNotNull(), F.col("objective_id_a") == F.col("objective_id_b")).otherwise(F.col("label_a") == F.col("label_b")), F.lit(False))
        solved, a, b = F.col("is_solved_a") | F.col("is_solved_b"), F.col("actor_a"), F.col("actor_b")
    bar = F.when(same | solved, same_bar).otherwise(cross_bar)
    out = pairs.where(F.col("sim") >= bar).select(a.alias("a"), b.alias("b"), "sim", same.alias("same_objective"), F.when(solved, "solved_reuse").otherwise("live_duplication").alias("mode"))
    return out if index is None else out.distinct()


def memory_tiers(best: DataFrame, serve: float = SERVE, warm: float = WARM) -> DataFrame:
    """What each row's best earlier one (``m``) offers: serve if near enough with language and model the same, else a warm start."""
    same = F.col("language_a").eqNullSafe(F.col("m.language_b"))
    tier = F.when((F.col("m.sim") >= serve) & same & (F.col("model_a") == F.col("m.request_model_b")), "serve").when(F.col("m.sim") >= warm, "warm_start")
    return best.withColumn("tm_tier", tier).where("tm_tier IS NOT NULL").select(
        F.col("seq_a").alias("seq"), "tm_tier", F.col("m.sim").alias("tm_similarity"), same.alias("tm_same_language"), F.col("m.actor_b").alias("tm_solver"),
        F.round(F.when(F.col("tm_tier") == "serve", F.col("m.cost_usd_b")).otherwise(F.col("m.cost_usd_b") * WARM_FRACTION), 6).alias("tm_shadow_usd"),
    )


FOUND = "seq_a long, language_a string, request_model_a string, sim double, o long, actor_b string, language_b string, request_model_b string, cost_usd_b double"


def best_earlier(rows: DataFrame, shards: int) -> DataFrame:
    """Each row's best earlier row in every cell that it is in: cells of two shards multiply their vectors, which serves both."""

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b, one = sides(batches, "seq")
        if not (a.num_rows and b.num_rows):
            return
        v, actors, seqs = (units(a), units(b)), codes(a["actor"], b["actor"]), (a["seq"].to_numpy(), b["seq"].to_numpy())
        for asks, holds in ((0, 1),) if one else ((0, 1), (1, 0)):
            for i in range(0, len(v[asks]), STEP):
                own, seq = actors[asks][i : i + STEP], seqs[asks][i : i + STEP]
                n = np.searchsorted(seqs[holds], seq[-1])  # those before the last of these
                if not n:
                    continue
                sims = np.round(v[asks][i : i + STEP] @ v[holds][:n].T, 6)
                # A null actor is never excluded.
                sims[(seqs[holds][None, :n] >= seq[:, None]) | ((own[:, None] == actors[holds][None, :n]) & (own >= 0)[:, None])] = -2
                top = sims.argmax(1)  # of equal ones the first, as they are in order
                found = np.flatnonzero(sims[np.arange(len(top)), top] > -2)
                x, y, sim = pa.array(found + i), pa.array(top[found]), sims[found, top[found]]
                take = lambda t, c, at: t[c].combine_chunks().take(at)
                q, m = (a, b)[asks], (a, b)[holds]
                yield pa.RecordBatch.from_pydict(
                    {"seq_a": take(q, "seq", x), "language_a": take(q, "language", x), "request_model_a": take(q, "request_model", x), "sim": sim, "o": -seqs[holds][top[found]]}
                    | {f"{c}_b": take(m, c, y) for c in ("actor", "language", "request_model", "cost_usd")}
                )

    s = rows.where("seq IS NOT NULL AND tenant_id IS NOT NULL").select(
        "tenant_id", F.size("embedding").alias("width"), F.col("seq").cast("long").alias("seq"), *[F.col(c).cast("string").alias(c) for c in ("actor", "language", "request_model")],
        F.col("cost_usd").cast("double").alias("cost_usd"), F.col("embedding").cast("array<double>").alias("embedding"),
    )
    return in_cells(s, "seq", shards).groupBy("tenant_id", "width", "lo", "hi").applyInArrow(meet, FOUND)


def team_memory(rows: DataFrame, serve: float = SERVE, warm: float = WARM, shards: int | None = None, index: Hyperplanes | None = None) -> DataFrame:
    """Each row's best earlier row of its tenant by another actor (a null actor is never excluded), and what it offers.

    Serve: near enough, same language and model; warm start: near enough. Equal similarity: the earliest row. A tenant's
    rows are dealt to ``shards``, by default so many that a shard has about ``GROUP`` of them; every two shards are a
    cell whose vectors one task multiplies, so a cell's size stays as it is however many rows a tenant has. With
    ``index`` rows are kept and looked up in their buckets, which finds near ones by ``index.chance`` and few others.
    """
    s = rows.where(valid_embedding(F.col("embedding")))
    if index is None:
        scored = best_earlier(s, shards or groups_of(rows, ["tenant_id"])).select("seq_a", "language_a", "request_model_a", F.struct("sim", "o", "actor_b", "language_b", "request_model_b", "cost_usd_b").alias("m"))
    else:
        s = s.withColumn("u", unit(F.col("embedding"))).withColumn("_cell", F.explode(signatures(F.col("embedding"), index)))
        side = lambda x: s.select(*[F.col(c).alias(f"{c}_{x}") for c in ("tenant_id", "_cell", "seq", "actor", "language", "request_model", "cost_usd", "u")])
        other = ~F.coalesce(F.col("actor_a") == F.col("actor_b"), F.lit(False))
        on = (F.col("tenant_id_a") == F.col("tenant_id_b")) & (F.col("_cell_a") == F.col("_cell_b")) & (F.col("seq_b") < F.col("seq_a")) & other
        scored = side("a").join(side("b"), on).select("seq_a", "language_a", "request_model_a", F.struct(F.round(_dot("u_a", "u_b"), 6).alias("sim"), F.negate("seq_b").alias("o"), "actor_b", "language_b", "request_model_b", "cost_usd_b").alias("m"))
    best = scored.groupBy("seq_a").agg(F.max("m").alias("m"), F.first("language_a").alias("language_a"), F.first("request_model_a").alias("model_a"))
    return memory_tiers(best, serve, warm)


def orphan_groups(rows: DataFrame, k: int = 5, bar: float = 0.82, newest: int = 2000) -> DataFrame:
    """Unattributed work of each tenant grouped around leaders: the first vector that fits no group leads a new one.

    Order matters and leaders never move, so a tenant's newest ``newest`` vectors meet in one task; that bound is the
    operator's own. Groups with fewer than k people are dropped.
    """
    w = Window.partitionBy("tenant_id").orderBy(F.desc("ts"), "event_id")
    bounded = rows.where(F.col("is_orphan") & valid_embedding(F.col("embedding"))).withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= newest)

    def lead(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_r")
        v = np.stack([np.asarray(x, float) for x in pdf.embedding])
        v /= np.linalg.norm(v, axis=1, keepdims=True)
        leaders, group = np.zeros((0, v.shape[1])), np.zeros(len(v), int)
        for i, x in enumerate(v):
            fit = np.flatnonzero(leaders @ x >= bar)
            if len(fit):
                group[i] = fit[0]
            else:
                group[i] = len(leaders)
                leaders = np.vstack([leaders, x])
        return pd.DataFrame({"tenant_id": pdf.tenant_id, "event_id": pdf.event_id, "cluster": group})

    led = bounded.groupBy("tenant_id").applyInPandas(lead, "tenant_id string, event_id string, cluster long")
    joined = bounded.join(led, ["tenant_id", "event_id"])
    per_repo = joined.groupBy("tenant_id", "cluster", "repo").agg(F.count("*").alias("n"))
    top = per_repo.groupBy("tenant_id", "cluster").agg(F.max(F.struct("n", "repo")).alias("m")).select("tenant_id", "cluster", F.col("m.repo").alias("top_repo"))
    g = joined.groupBy("tenant_id", "cluster").agg(F.count("*").alias("calls"), F.count_distinct("actor_pseudonym").alias("actors"), F.round(F.sum("cost_usd"), 4).alias("spend"))
    return g.where(F.col("actors") >= k).join(top, ["tenant_id", "cluster"]).withColumn("proposed_label", F.concat(F.lit("Work in "), F.coalesce("top_repo", F.lit("unknown"))))
