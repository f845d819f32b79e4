"""Vector matching over streams by keyed state: people on the same problem, and earlier solutions of a team.

Both keep vectors in the state store under keys that no single task has to hold: a wall's people are dealt to groups and
every two groups meet in a cell of their own; a team's memory is dealt to shards, or to the buckets of random
hyperplanes. A batch costs what its rows and the cells that they touch cost, however long the stream has run.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.columns import valid_embedding
from ..operators import matching

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class state_in_rocksdb:
    """``with state_in_rocksdb(spark):`` queries that start inside keep their state there, as keyed state of several parts needs."""

    NAME = "spark.sql.streaming.stateStore.providerClass"

    def __init__(self, spark: SparkSession):
        self.spark = spark

    def __enter__(self):
        self.before = self.spark.conf.get(self.NAME, None)
        self.spark.conf.set(self.NAME, ROCKSDB)

    def __exit__(self, *_):
        if self.before is None:
            self.spark.conf.unset(self.NAME)
        else:
            self.spark.conf.set(self.NAME, self.before)


def _unit(vectors: pd.Series) -> np.ndarray:
    v = np.stack([np.asarray(x, float) for x in vectors])
    return v / np.linalg.norm(v, axis=1, keepdims=True)


MATCH = "a string, b string, sim double, same_objective boolean, mode string, topic string, event_id string, ts timestamp"


class _Broker(StatefulProcessor):
    """One cell of a wall: the latest signal of each person, and with whom the first by name of a pair was told of."""

    def __init__(self, same_bar: float, cross_bar: float, ttl_ms: int | None):
        self.same_bar, self.cross_bar, self.ttl_ms = same_bar, cross_bar, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.latest = handle.getMapState("latest", "actor string", "grp int, client string, objective_id string, label string, is_solved boolean, v binary", self.ttl_ms)
        self.told = handle.getMapState("told", "a string", "b array<string>, at array<long>", self.ttl_ms)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(rows)).sort_values(["ts", "event_id"], ignore_index=True)  # a batch's signals of one cell
        one = key[2] // 1000 == key[2] % 1000
        held = [(k[0], tuple(v)) for k, v in self.latest.iterator()]
        n, before = len(rows), len(held)
        # Signals are those that are held, then the batch's; each counts from its own arrival until its person's next.
        names = sorted({*rows.actor, *(a for a, _ in held)})
        at = {a: i for i, a in enumerate(names)}
        who = np.array([at[a] for a, _ in held] + [at[a] for a in rows.actor])
        given = [[x if _given(x) else None for x in rows[c]] for c in ("client", "objective_id", "label")]
        client, objective, label = (pd.factorize(np.array([v[i] for _, v in held] + x, object))[0] for i, x in enumerate(given, 1))
        topic = np.array([v[3] for _, v in held] + given[2], object)
        grp, solved = np.array([v[0] for _, v in held] + rows.grp.tolist()), np.array([v[4] for _, v in held] + rows.is_solved.tolist(), bool)
        vectors = _unit(rows.embedding)
        if held:
            vectors = np.vstack([np.frombuffer(b"".join(v[5] for _, v in held)).reshape(before, -1), vectors])
        start = np.concatenate([np.full(before, -1), np.arange(n)])
        until, following = np.full(before + n, n), {}
        for i in range(before + n - 1, -1, -1):
            until[i] = following.get(who[i], n)
            following[who[i]] = start[i]
        told = np.zeros((len(names), -(-len(names) // 8)), np.uint8)  # a bit for each pair, in the row of its first by name
        old: dict[int, tuple[list, list]] = {}
        was_told, now = self.told.exists(), timers.getCurrentProcessingTimeInMs() if self.ttl_ms else 0
        people = np.array(names, object)
        for i in range(0, n, matching.STEP):
            live = np.flatnonzero((start < i + matching.STEP) & (until > i))
            sims = vectors[before + i : before + i + matching.STEP] @ vectors[live].T
            x, y = np.nonzero(sims >= min(self.same_bar, self.cross_bar) - 1e-6)
            sim, x, y = np.round(sims[x, y], 6), x + before + i, live[y]
            both = (objective[x] >= 0) & (objective[y] >= 0)
            same = np.where(both, objective[x] == objective[y], (label[x] >= 0) & (label[x] == label[y]))
            reuse = solved[x] | solved[y]
            meet = (start[y] < start[x]) & (until[y] > start[x]) & (who[x] != who[y]) & (client[x] == client[y]) & (sim >= np.where(same | reuse, self.same_bar, self.cross_bar))
            if not one:
                meet &= grp[x] != grp[y]  # two of one group meet in that group's own cell
            a, b = np.minimum(who[x], who[y]), np.maximum(who[x], who[y])
            for k in np.unique(a[meet]).tolist():
                if k not in old:
                    old[k] = self._told_before(names[k], now) if was_told else ([], [])
                    _mark(told, k, np.array([at[p] for p in old[k][0] if p in at], int))
            found = np.flatnonzero(meet)
            found = found[(told[a[found], b[found] >> 3] >> (b[found] & 7) & 1) == 0]
            found = np.sort(found[np.unique(a[found] * len(names) + b[found], return_index=True)[1]])  # of a pair's the first to arrive
            if not len(found):
                continue
            a, b, x = a[found], b[found], x[found]
            _mark(told, a, b)
            own = rows.iloc[x - before]
            yield pd.DataFrame({"a": people[a], "b": people[b], "sim": sim[found], "same_objective": same[found].astype(bool), "mode": np.where(reuse[found], "solved_reuse", "live_duplication").astype(object), "topic": topic[y[found]], "event_id": own.event_id.to_numpy(), "ts": own.ts.array})
        for k, (others, times) in old.items():
            had = set(others)
            more = [p for p in people[np.flatnonzero(np.unpackbits(told[k], count=len(names), bitorder="little"))] if p not in had]
            if more:
                self.told.updateValue((names[k],), (others + more, times + [now] * len(more)))
        for k, i in {w: i for i, w in enumerate(who[before:].tolist(), before)}.items():
            facts = [x[i - before] for x in given]
            self.latest.updateValue((names[k],), (int(grp[i]), *facts, bool(solved[i]), vectors[i].tobytes()))

    def _told_before(self, name: str, now: int) -> tuple[list, list]:
        """With whom, and when; without pairs whose time is over."""
        if not self.told.containsKey((name,)):
            return [], []
        pairs = [(b, t) for b, t in zip(*self.told.getValue((name,)), strict=True) if not self.ttl_ms or t + self.ttl_ms > now]
        return [b for b, _ in pairs], [t for _, t in pairs]

    def close(self) -> None:
        pass


def _mark(bits: np.ndarray, a, b: np.ndarray) -> None:
    np.bitwise_or.at(bits, (a, b >> 3), (1 << (b & 7)).astype(np.uint8))


def _given(x) -> bool:
    return isinstance(x, str)


def match_arrivals(signals: DataFrame, walls: tuple[str, ...] = ("org", "residency"), same_bar: float = matching.SAME_BAR, cross_bar: float = matching.CROSS_BAR, groups: int = 4, ttl_ms: int | None = None, mutual: DataFrame | None = None) -> DataFrame:
    """Each arriving signal against the latest one of everybody else behind the same walls; a pair is told once.

    Columns as for ``matching.broker_matches``; signals of a batch arrive by (ts, event_id). A person stays behind the
    same ``walls``, which key the state; the client is that of the signal, and only equal ones (or none) match. ``groups`` deals the people
    of a wall to so many groups, whose pairs are cells (999 at most); a task holds a cell's people, so let them grow with
    the largest wall (``matching.groups_of``). ``mutual`` (a, b) holds pairs who agreed already;
    they are left out. With ``ttl_ms`` state that isn't written for so long is forgotten; without it, it stays.
    """
    good = signals.where(valid_embedding(F.col("embedding")) & F.col("actor").isNotNull())
    own = matching.group_of(F.col("actor"), groups)
    keyed = good.select(
        F.to_json(F.struct(*walls)).alias("wall"), F.size("embedding").alias("width"), F.explode(matching.cells_of(own, groups)).alias("cell"), own.alias("grp"),
        "actor", "client", F.col("event_id").cast("string").alias("event_id"), F.col("ts").cast("timestamp").alias("ts"), "objective_id", "label", F.coalesce("is_solved", F.lit(False)).alias("is_solved"), F.col("embedding").cast("array<double>").alias("embedding"),
    )
    out = keyed.groupBy("wall", "width", "cell").transformWithStateInPandas(_Broker(same_bar, cross_bar, ttl_ms), MATCH, "Append", "None" if ttl_ms is None else "ProcessingTime")
    return out if mutual is None else out.join(mutual.select("a", "b").distinct(), ["a", "b"], "left_anti")


BEST = "seq long, sim double, o long, actor string, language string, request_model string, cost_usd double, own_language string, own_model string"
#: Entries of a block of memory, which is read and written as one value.
BLOCK = 256


class _Memory(StatefulProcessor):
    """One cell of a team's memory: entries in blocks, in order of arrival. ``most``: entries kept in a cell."""

    def __init__(self, most: int | None, ttl_ms: int | None):
        self.most, self.ttl_ms = most, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.blocks = handle.getMapState("blocks", "k int", "v binary, seq binary, cost binary, actor array<string>, language array<string>, model array<string>", self.ttl_ms)
        self.size = handle.getValueState("size", "n long", self.ttl_ms)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(rows)).sort_values("seq").reset_index(drop=True)  # a batch's rows of one cell
        new, seq = _unit(rows.embedding), rows.seq.to_numpy()
        words = [[x if _given(x) else None for x in rows[c]] for c in ("actor", "language", "request_model")]
        cost = rows.cost_usd.to_numpy(float)
        n = int(self.size.get()[0]) if self.size.exists() else 0
        best: list[tuple | None] = [None] * len(rows)

        def meet(v: np.ndarray, its_seq: np.ndarray, its_cost: np.ndarray, its: list[list], skip: np.ndarray, allowed=None) -> None:
            sims = np.round(new @ v.T, 6)
            codes: dict[str, int] = {}
            own, that = (np.array([-1 if x is None else codes.setdefault(x, len(codes)) for x in w]) for w in (words[0], its[0]))
            bad = ((own[:, None] == that[None, :]) & (own >= 0)[:, None]) | skip  # a null actor is never excluded
            if allowed is not None:
                bad |= ~allowed
            sims[bad] = -2
            for i, top in enumerate(sims.max(1, initial=-2)):
                if top > -2 and (best[i] is None or top >= best[i][0]):
                    ties = np.flatnonzero(sims[i] == top)
                    j = ties[np.argmin(its_seq[ties])]
                    found = (float(top), -int(its_seq[j]), its[0][j], its[1][j], its[2][j], float(its_cost[j]))
                    best[i] = found if best[i] is None else max(best[i], found, key=lambda x: x[:2])

        first = max(0, n - self.most) if self.most else 0
        for k in range(first // BLOCK, -(-n // BLOCK)):
            if not self.blocks.containsKey((k,)):
                continue  # forgotten
            b = self.blocks.getValue((k,))
            its_seq = np.frombuffer(b[1], np.int64)
            v = np.frombuffer(b[0]).reshape(len(its_seq), -1)
            meet(v, its_seq, np.frombuffer(b[2]), [list(b[3]), list(b[4]), list(b[5])], (k * BLOCK + np.arange(len(its_seq)) < first)[None, :])
        stored = rows.stores.to_numpy(bool)
        for i in range(0, len(rows), BLOCK):
            cut = slice(i, i + BLOCK)
            meet(new[cut], seq[cut], cost[cut], [w[cut] for w in words], ~stored[cut][None, :], seq[cut][None, :] < seq[:, None])
        keep = np.flatnonzero(stored)
        while len(keep):
            k, have = divmod(n, BLOCK)
            take, keep = keep[: BLOCK - have], keep[BLOCK - have :]
            old = self.blocks.getValue((k,)) if have and self.blocks.containsKey((k,)) else (b"", b"", b"", [], [], [])
            texts = [list(o) + [w[i] for i in take.tolist()] for o, w in zip(old[3:], words, strict=True)]
            self.blocks.updateValue((k,), (bytes(old[0]) + new[take].tobytes(), bytes(old[1]) + seq[take].astype(np.int64).tobytes(), bytes(old[2]) + cost[take].tobytes(), *texts))
            n += len(take)
        self.size.update((n,))
        for k in range(first // BLOCK - 1, -1, -1):  # blocks that no longer count
            if not self.blocks.containsKey((k,)):
                break
            self.blocks.removeKey((k,))
        out = [(int(s), *b, words[1][i], words[2][i]) for i, (s, b) in enumerate(zip(seq, best, strict=True)) if b is not None]
        if out:
            yield pd.DataFrame(out, columns=[c.split()[0] for c in BEST.split(", ")])

    def close(self) -> None:
        pass


def remembered(rows: DataFrame, shards: int = 8, index: matching.Hyperplanes | None = None, most: int | None = None, ttl_ms: int | None = None) -> DataFrame:
    """Each arriving row's best earlier rows, one a cell that it visits; ``merge_memory`` makes answers of a batch's.

    Columns as for ``matching.team_memory``; rows of a batch arrive by ``seq``. Without ``index`` a row is kept in one
    of its tenant's ``shards`` and looks into all of them, so nothing is missed. With it, a row is kept and looked up
    in its bucket of each of the index's tables. ``most`` entries are kept a cell (the oldest go), for ``ttl_ms`` if given.
    """
    good = rows.where(valid_embedding(F.col("embedding")))
    if index is None:
        own = matching.group_of(F.col("seq"), shards)
        cells = F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), lambda s: F.struct(s.cast("long").alias("cell"), (s == own).alias("stores")))
    else:
        cells = F.transform(matching.signatures(F.col("embedding"), index), lambda s: F.struct(s.alias("cell"), F.lit(True).alias("stores")))
    columns = ["seq", "actor", "language", "request_model", "cost_usd"]
    keyed = good.select(F.to_json(F.struct("tenant_id")).alias("tenant"), F.size("embedding").alias("width"), F.explode(cells).alias("c"), F.col("seq").cast("long").alias("seq"), *[F.col(c) for c in columns[1:4]], F.col("cost_usd").cast("double").alias("cost_usd"), F.col("embedding").cast("array<double>").alias("embedding"))
    keyed = keyed.select("tenant", "width", "c.cell", "c.stores", *columns, "embedding")
    return keyed.groupBy("tenant", "width", "cell").transformWithStateInPandas(_Memory(most, ttl_ms), BEST, "Append", "None" if ttl_ms is None else "ProcessingTime")


def merge_memory(best: DataFrame, serve: float = matching.SERVE, warm: float = matching.WARM) -> DataFrame:
    """A batch's answers from what its cells found."""
    m = F.struct("sim", "o", F.col("actor").alias("actor_b"), F.col("language").alias("language_b"), F.col("request_model").alias("request_model_b"), F.col("cost_usd").alias("cost_usd_b"))
    top = best.groupBy(F.col("seq").alias("seq_a")).agg(F.max(m).alias("m"), F.first("own_language").alias("language_a"), F.first("own_model").alias("model_a"))
    return matching.memory_tiers(top, serve, warm)


MEMORY = "seq long, tm_tier string, tm_similarity double, tm_same_language boolean, tm_solver string, tm_shadow_usd double"
