"""Keyed state: debounce and TTL caches, resent history, last and answered prompts. Each has a batch twin in ``operators.waste``.

``forget_ms``: keys without a row for so long (of processing time) are forgotten; without it they stay. Such a stream
has batches without rows for ever, so it isn't for ``jobs.drained``. A key's rows of
one batch are sorted together, so a batch's size bounds what a task holds; a trigger's ``maxFilesPerTrigger`` sets it.
"""

from __future__ import annotations

import difflib
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

DEBOUNCE_OUT = "key string, event_id string, ts timestamp, allowed boolean"


def _timeout(forget_ms: int | None) -> str:
    return GroupStateTimeout.NoTimeout if forget_ms is None else GroupStateTimeout.ProcessingTimeTimeout


def _forgotten(state: GroupState) -> bool:
    """Whether this call is for a key whose time is over; its state is gone then."""
    if state.hasTimedOut:
        state.remove()
        return True
    return False


def _keep(state: GroupState, value: tuple, forget_ms: int | None) -> None:
    state.update(value)
    if forget_ms is not None:
        state.setTimeoutDuration(forget_ms)


def debounce(stream: DataFrame, cooldown_seconds: float, forget_ms: int | None = None) -> DataFrame:
    """Allow one event per key per cooldown, measured from the last *allowed* one. Columns key, event_id, ts."""

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if _forgotten(state):
            return
        last = state.get[0] if state.exists else None
        rows = pd.concat(list(parts)).sort_values(["ts", "event_id"])
        allowed = []
        for t in rows.ts.astype("int64") / 1e9 if rows.ts.dtype == "datetime64[ns]" else rows.ts.map(lambda x: x.timestamp()):
            ok = last is None or t - last > cooldown_seconds
            last = t if ok else last
            allowed.append(ok)
        _keep(state, (last,), forget_ms)
        yield pd.DataFrame({"key": key[0], "event_id": rows.event_id, "ts": rows.ts, "allowed": allowed})

    return stream.groupBy("key").applyInPandasWithState(step, DEBOUNCE_OUT, "last double", "append", _timeout(forget_ms))


def resent_runs(stream: DataFrame, forget_ms: int | None = None) -> DataFrame:
    """Leading messages that a conversation's previous request had too. Columns conv_id, turn, fingerprints (array)."""

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if _forgotten(state):
            return
        before = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(parts)).sort_values("turn")
        runs = []
        for prints in rows.fingerprints:
            n = 0
            for a, b in zip(prints, before):
                if a != b:
                    break
                n += 1
            runs.append(n)
            before = list(prints)
        _keep(state, (before,), forget_ms)
        yield pd.DataFrame({"conv_id": key[0], "turn": rows.turn, "resent_messages": runs})

    return stream.groupBy("conv_id").applyInPandasWithState(step, "conv_id long, turn long, resent_messages int", "fingerprints array<string>", "append", _timeout(forget_ms))


def words(text: str) -> frozenset:
    return frozenset(re.findall("[a-z0-9_]+", text.lower()))


def jaccard(a: str, b: str) -> float:
    x, y = words(a), words(b)
    return len(x & y) / len(x | y) if x | y else 0.0


def ratio(a: str, b: str) -> float:
    return difflib.SequenceMatcher(None, a.lower(), b.lower()).ratio()


def prompts_seen(stream: DataFrame, bar: float = 0.92, back: int = 4, answered_bar: float = 0.85, answered_back: int = 100, similarity: Callable[[str, str], float] = ratio, forget_ms: int | None = None) -> DataFrame:
    """Prompts like one of the actor's last ``back``, or like one of the last ``answered_back`` answered ones.

    Columns actor, event_id, ts, prompt, answered; out come ``retry`` and ``answered`` (similarities, null below the
    bar). Half is word Jaccard, half ``similarity``, which only runs where the first half leaves a chance.
    """

    def best(prompt: str, own: frozenset, past: list, least: float) -> float | None:
        top = 0.0
        for old, its in past:
            both = len(own | its)
            j = len(own & its) / both if both else 0.0
            if j >= 2 * least - 1 and (j + 1) / 2 > top:
                top = max(top, (j + similarity(prompt, old)) / 2)
        return round(top, 4) if top >= least else None

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if _forgotten(state):
            return
        last, told = ([(t, words(t)) for t in x] for x in state.get) if state.exists else ([], [])
        out = []
        for r in pd.concat(list(parts)).sort_values(["ts", "event_id"]).itertuples():
            own = words(r.prompt)
            found = best(r.prompt, own, last, bar), best(r.prompt, own, told, answered_bar)
            if found != (None, None):
                out.append((key[0], r.event_id, *found))
            last = [*last, (r.prompt, own)][-back:]
            told = [*told, (r.prompt, own)][-answered_back:] if r.answered else told
        _keep(state, tuple([t for t, _ in x] for x in (last, told)), forget_ms)
        yield pd.DataFrame(out, columns=["actor", "event_id", "retry", "answered"]).astype({"retry": float, "answered": float})

    return stream.groupBy("actor").applyInPandasWithState(step, "actor long, event_id string, retry double, answered double", "last array<string>, told array<string>", "append", _timeout(forget_ms))


def retries(stream: DataFrame, bar: float = 0.92, back: int = 4, forget_ms: int | None = None) -> DataFrame:
    """Prompts like one of the actor's last ``back``. Columns actor, event_id, ts, prompt."""
    from pyspark.sql import functions as F

    out = prompts_seen(stream.withColumn("answered", F.lit(False)), bar, back, forget_ms=forget_ms)
    return out.where("retry IS NOT NULL").select("actor", "event_id", F.col("retry").alias("similarity"))
