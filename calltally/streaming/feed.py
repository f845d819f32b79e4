"""The live feed: waste, saving, match and budget lines as calls arrive, each once."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.reports import AT_RISK
from ..operators.waste import resend_signal

#: A line: its kind, the call it came with, whom it is for, what it is about, the dollars at stake.
LINE = ("kind", "event_id", "actor", "topic", "usd", "ts")
SAVED_LEAST = 0.0001


class _Budget(StatefulProcessor):
    """One objective's month: what was spent, in whole millionths, and the last status that was told."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("spent", "micros long, status string")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        rows = pd.concat([p[["ts", "event_id", "actor_pseudonym", "micros", "budget"]] for p in rows]).sort_values(["ts", "event_id"])
        spent, status = (int(self.state.get()[0]), self.state.get()[1]) if self.state.exists() else (0, "ok")
        budget = float(rows.budget.iloc[0]) * 1e6
        after = spent + rows.micros.cumsum()
        now = pd.Series("ok", rows.index).mask(after >= AT_RISK * budget, "at_risk").mask(after >= budget, "over")
        tells = now != now.shift(fill_value=status)
        told = rows[tells]
        self.state.update((int(after.iloc[-1]), now.iloc[-1]))
        if len(told):
            yield pd.DataFrame({"kind": "budget_" + now[tells], "event_id": told.event_id, "actor": told.actor_pseudonym, "topic": key[0], "usd": (after[tells] / 1e6).round(6), "ts": told.ts})

    def close(self) -> None:
        pass


def budget_lines(calls: DataFrame, objectives: DataFrame) -> DataFrame:
    """A line when a call moves its objective's month from one status to another (ok, at risk from 80 %, over).

    ``usd`` is what the month has cost then. Calls of a batch count by (ts, event_id). Objectives without a budget and
    calls without an objective have no lines.
    """
    budgets = objectives.where("monthly_budget_usd > 0").select("objective_id", F.col("monthly_budget_usd").cast("double").alias("budget"))
    keyed = calls.where("objective_id IS NOT NULL").join(budgets, "objective_id").select(
        "objective_id", F.date_trunc("month", F.col("ts")).alias("month"), "ts", F.col("event_id").cast("string").alias("event_id"), "actor_pseudonym", F.round(F.coalesce("cost_usd", F.lit(0.0)) * 1e6).cast("long").alias("micros"), "budget"
    )
    return keyed.groupBy("objective_id", "month").transformWithStateInPandas(_Budget(), "kind string, event_id string, actor string, topic string, usd double, ts timestamp", "Append", "None")


def saving_lines(calls: DataFrame) -> DataFrame:
    """Calls served from the cache, and easy ones that went to a cheaper model."""
    hit = F.when(F.coalesce("served_from_cache", F.lit(False)), F.struct(F.lit("cache_hit").alias("kind"), F.lit(0.0).alias("usd"), F.col("request_model").alias("topic")))
    routed = F.when(F.col("route_saved_usd") >= SAVED_LEAST, F.struct(F.lit("routing").alias("kind"), F.col("route_saved_usd").cast("double").alias("usd"), F.col("route_target").alias("topic")))
    out = calls.withColumn("x", F.explode(F.array_compact(F.array(hit, routed))))
    return out.select("x.kind", F.col("event_id").cast("string").alias("event_id"), F.col("actor_pseudonym").alias("actor"), "x.topic", "x.usd", "ts")


def waste_lines(priced: DataFrame) -> DataFrame:
    """Resent history that isn't cached, bloated contexts, and calls that a cheap model would do for."""
    out = resend_signal(priced).where("signal IS NOT NULL")
    return out.select(F.col("signal").alias("kind"), F.col("event_id").cast("string").alias("event_id"), F.col("actor_pseudonym").alias("actor"), F.col("request_model").alias("topic"), F.col("cache_saving_usd").cast("double").alias("usd"), "ts")


def match_lines(matches: DataFrame) -> DataFrame:
    """A match, told to both sides without saying who the other is."""
    side = F.explode(F.array("a", "b")).alias("actor")
    return matches.select(F.concat(F.lit("match_"), "mode").alias("kind"), "event_id", side, F.col("topic"), F.lit(0.0).alias("usd"), "ts")


def live_feed(priced: DataFrame, objectives: DataFrame, matches: DataFrame | None = None) -> DataFrame:
    """All lines of a stream (or table) of priced calls, and of matches if given."""
    out = waste_lines(priced).unionByName(saving_lines(priced)).unionByName(budget_lines(priced, objectives))
    return out if matches is None else out.unionByName(match_lines(matches))
