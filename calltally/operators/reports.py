"""Composite reports: budgets, drift, renewal pack, ledger, benchmark, exchange."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.columns import ratio
from ..functions.privacy import EPSILON, K, laplace, noisy, suppress, withhold
from ..sources.dims import MAINTENANCE, NET_NEW
from . import aggregates as A

AT_RISK, FORECAST_MIN_ELAPSED, ELAPSED_FLOOR = 0.80, 0.15, 0.04


def budget_status(rows: DataFrame, objectives: DataFrame, start: datetime, end: datetime, now: datetime, k: int = K, gated: bool = False) -> DataFrame:
    """Each budgeted objective's spend in the period, run-rate forecast and state; one aggregate for all of them.

    ``gated``: objectives on which fewer than k people (but someone) spent show no figures and state ``suppressed``.
    """
    elapsed = min(max((now - start).total_seconds() / max((end - start).total_seconds(), 1e-9), 0.0), 1.0)
    spend = A.in_window(rows, start, now, inclusive=True).where("objective_id IS NOT NULL").groupBy("objective_id").agg(F.round(F.sum("cost_usd"), 6).alias("s"), F.count_distinct("actor_pseudonym").alias("actors"))
    b = F.col("monthly_budget_usd")
    joined = objectives.where(b > 0).join(spend, "objective_id", "left").fillna({"s": 0.0, "actors": 0})
    forecast = F.col("s") / max(elapsed, ELAPSED_FLOOR)
    state = F.when(F.col("s") >= b, "over").when(F.col("s") / b >= AT_RISK, "at_risk").when(F.lit(elapsed >= FORECAST_MIN_ELAPSED) & (forecast > b), "at_risk").otherwise("ok")
    out = joined.select(
        "objective_id", "objective_label", b.alias("budget_usd"), F.round("s", 4).alias("spent_usd"), F.round(F.col("s") / b, 4).alias("pct"), F.round(forecast, 4).alias("forecast_usd"),
        F.round(F.greatest(F.lit(0.0), forecast - b), 4).alias("projected_overrun_usd"), state.alias("status"), "actors",
    )
    if gated:
        hide = F.col("actors").between(1, k - 1)
        for c in ("spent_usd", "pct", "forecast_usd", "projected_overrun_usd"):
            out = out.withColumn(c, F.when(~hide, F.col(c)))
        out = out.withColumn("status", F.when(hide, "suppressed").otherwise(F.col("status")))
    return out.orderBy(F.desc("pct"))


def budget_snapshot(status: DataFrame) -> DataFrame:
    """Content-free: state and capped shares only."""
    return status.select("objective_id", "status", F.round(F.least("pct", F.lit(9.99)), 3).alias("pct"), F.round(F.col("forecast_usd") / F.col("budget_usd"), 3).alias("forecast_pct"))


def guardrail(label: Column, status: Column, pct: Column, forecast_pct: Column) -> Column:
    whole = lambda c: F.floor(c * 100 + 1e-9).cast("string")
    over = F.concat(F.lit("Budget of "), label, F.lit(" is spent ("), whole(pct), F.lit("%); use a smaller model or less context until it resets."))
    risk = F.concat(F.lit("Budget of "), label, F.lit(" is "), whole(pct), F.lit("% spent, on track for "), whole(forecast_pct), F.lit("% by the period's end."))
    return F.when(status == "over", over).when(status == "at_risk", risk)


def drift(rows: DataFrame, k: int = 1, by: list[str] | None = None, orphan_alert: float = 0.10, cost_alert: float = 0.25) -> DataFrame:
    """The later half of the time range against the earlier one; no row where a half is empty, no figures below k.

    Rows or daily sums. They are first summed by time and person, which the bounds and the halves are read from; Spark
    broadcasts the bounds if they are few, as they are one row a scope; ``by``: for every tenant at once.
    """
    by, t = by or [], A.micros()
    small = rows.groupBy(*by, t.alias("t"), "actor_pseudonym").agg(
        A.calls_of(rows).alias("calls"), F.sum("cost_usd").alias("cost"), F.sum(F.when(F.col("is_orphan"), A.tokens()).otherwise(0)).alias("orphan"), F.sum(A.tokens()).alias("tokens")
    )
    bounds = small.groupBy(*by).agg(F.min("t").alias("lo"), F.max("t").alias("hi")).where("hi > lo")
    joined = small.join(bounds, by) if by else small.join(F.broadcast(bounds))  # without scopes it is one row
    late = F.col("t") >= (F.col("lo") + F.col("hi")) / 2
    aggs = []
    for name, cond in (("prior", ~late), ("recent", late)):
        half = lambda c, cond=cond: F.sum(F.when(cond, F.col(c)))
        aggs += [
            F.coalesce(half("calls"), F.lit(0)).alias(f"{name}_events"), F.count_distinct(F.when(cond, F.col("actor_pseudonym"))).alias(f"{name}_actors"),
            F.round(F.coalesce(half("cost"), F.lit(0.0)), 6).alias(f"{name}_cost"), ratio(half("orphan"), half("tokens")).alias(f"{name}_orphan_share"),
        ]
    out = joined.groupBy(*by).agg(*aggs).where("prior_events > 0 AND recent_events > 0")
    ok = F.least("prior_actors", "recent_actors") >= k
    cost, share = F.col("recent_cost") - F.col("prior_cost"), F.col("recent_orphan_share") - F.col("prior_orphan_share")
    rel = F.when(F.col("prior_cost") != 0, cost / F.col("prior_cost")).otherwise(F.when(F.col("recent_cost") != 0, 1.0).otherwise(0.0))
    show = lambda c: F.when(ok, c)
    return out.select(
        *by, "prior_actors", "recent_actors", (~ok).alias("suppressed"),
        *[show(F.col(f"{n}_{c}")).alias(f"{n}_{c}") for n in ("prior", "recent") for c in ("events", "cost", "orphan_share")],
        show(F.round(cost, 6)).alias("cost_delta"), show(F.round(share, 6)).alias("orphan_delta"),
        F.coalesce(show((cost > 0) & (rel >= cost_alert)), F.lit(False)).alias("cost_alert"), F.coalesce(show(F.abs(F.round(share, 6)) >= orphan_alert), F.lit(False)).alias("orphan_alert"),
    )


def renewal_pack(rows: DataFrame, k: int = K) -> DataFrame:
    """Blended rate, concentration of providers that enough people use, annual run rate, and three scenarios."""
    per = A.rollup(rows, "provider")
    t = A.micros()
    total = rows.agg(F.round(F.sum("cost_usd"), 6).alias("cost"), F.sum(A.tokens()).alias("tokens"), ((F.max(t) - F.min(t)) / 86_400e6).alias("days"))
    shares = per.where(F.col("actors") >= k).join(F.broadcast(total.select(F.col("cost").alias("all_cost")))).agg(F.round(F.sum(F.pow(F.try_divide("cost", "all_cost"), 2)), 6).alias("concentration"))
    annual = F.col("cost") / F.greatest(F.col("days"), F.lit(1.0)) * 365
    base = total.join(F.broadcast(shares)).select(ratio(F.col("cost") * 1_000_000, F.col("tokens"), 4).alias("usd_per_mtok"), "concentration", annual.alias("_annual"))
    return base.select("usd_per_mtok", "concentration", F.round("_annual", 2).alias("annual_usd"), "_annual", F.explode(F.array(*map(F.lit, (10, 20, 30)))).alias("discount_pct")).withColumn(
        "saving_usd", F.round(F.col("_annual") * F.col("discount_pct") / 100, 2)
    ).drop("_annual")


# Ledger of solved-once work.
SOLVED, LIVE = 1.0, 0.5


def _ranked(costs: DataFrame, by: list[str]) -> DataFrame:
    w = Window.partitionBy(*by)
    return costs.withColumns({"r": F.row_number().over(w.orderBy("cost", "actor_pseudonym")), "n": F.count("*").over(w)})


def _middle() -> Column:
    """From four people on, a tenth (at least one) goes from either end."""
    trim = F.when(F.col("n") >= 4, F.greatest(F.lit(1), F.floor(F.col("n") / 10))).otherwise(0)
    return (F.col("r") > trim) & (F.col("r") <= F.col("n") - trim)


def _solve_cost(of: Column) -> list[Column]:
    """The mean cost of the people that ``of`` holds for, and how many there were before the ends went."""
    return [F.round(F.avg(F.when(of, F.col("cost"))) + 1e-9, 6).alias("cost_to_solve"), F.max(F.when(of, F.col("n"))).alias("cohort")]


def cost_to_solve(costs: DataFrame, by: list[str]) -> DataFrame:
    """Trimmed mean of the people's costs: from four on, a tenth (at least one) goes from either end."""
    return _ranked(costs, by).where(_middle()).groupBy(*by).agg(*_solve_cost(F.lit(True)))


def book(opportunities: DataFrame, more: Sequence[str] = ()) -> DataFrame:
    """One entry for each key: first time stays, and a live duplicate may become a solved reuse but not the reverse. The greatest of ``more``."""
    solved = F.col("mode") == "solved_reuse"
    return opportunities.groupBy("dedup_key", "tenant_id", "objective_id", "work_type").agg(
        F.min("ts").alias("ts"), F.when(F.max(solved), "solved_reuse").otherwise("live_duplication").alias("mode"),
        F.min("actor_a").alias("actor_a"), F.min("actor_b").alias("actor_b"),
        F.coalesce(F.max_by(F.when(solved, F.col("cluster_label")), F.when(solved, F.col("ts"))), F.min_by("cluster_label", "ts")).alias("cluster_label"),
        *[F.max(c).alias(c) for c in more],
    )


def ledger_summary(booked: DataFrame, costs: DataFrame, k: int = K) -> DataFrame:
    """Clusters by (tenant, objective, work type): participants less one solves avoided, credited from k people's costs."""
    by = ["tenant_id", "objective_id", "work_type"]
    people = booked.select(*by, "mode", F.explode(F.array("actor_a", "actor_b")).alias("actor"))
    clusters = people.groupBy(*by).agg(F.count_distinct("actor").alias("participants"), F.max(F.col("mode") == "solved_reuse").alias("solved"))
    return _credited(clusters.join(cost_to_solve(costs, by), by, "left"), by, k)


def _credited(clusters: DataFrame, by: list[str], k: int) -> DataFrame:
    known = clusters.fillna({"cohort": 0, "cost_to_solve": 0.0})
    value = F.round((F.col("participants") - 1) * F.col("cost_to_solve") * F.when(F.col("solved"), SOLVED).otherwise(LIVE) + 1e-9, 6)
    ok = F.col("cohort") >= k
    return known.select(*by, "participants", "solved", (F.col("participants") - 1).alias("avoided_solves"), F.when(ok, value).otherwise(0.0).alias("credited_usd"), (~ok).alias("suppressed"))


def ledger_of_months(months: DataFrame, k: int = K) -> DataFrame:
    """The same summary straight from people's months: ``actor_b``, the month's first ``actor_a``, ``mode``, ``cost``.

    A month's first actor pairs with everyone else there, so all people of a month of two or more take part, and booked
    pairs needn't be made. Every step is by (tenant, objective, work type), as the months may lie already.
    """
    by = ["tenant_id", "objective_id", "work_type"]
    paired = F.max("actor_b").over(Window.partitionBy(*by, "m")) != F.col("actor_a")
    people = months.where("actor_b IS NOT NULL").withColumn("paired", paired).groupBy(*by, F.col("actor_b").alias("actor_pseudonym")).agg(
        F.max("paired").alias("paired"), F.max((F.col("mode") == "solved_reuse") & (F.col("actor_a") != F.col("actor_b"))).alias("solved"), F.round(F.sum("cost"), 6).alias("cost")
    )
    ranked = _ranked(people.withColumn("priced", F.coalesce(F.col("cost") > 0, F.lit(False))), [*by, "priced"])
    clusters = ranked.groupBy(*by).agg(F.count_if("paired").alias("participants"), F.max("solved").alias("solved"), *_solve_cost(F.col("priced") & _middle()))
    return _credited(clusters.where("participants > 0"), by, k)


def participants(matches: DataFrame, cluster: str) -> DataFrame:
    """How many different people a cluster's matches name, on either side."""
    people = matches.select(cluster, F.explode(F.array("a", "b")).alias("person")).distinct()
    return people.groupBy(cluster).agg(F.count("*").alias("participants"))


# Benchmark between tenants.
def cohort(tenants: DataFrame, org: str, own: DataFrame) -> DataFrame:
    """The tenants that a tenant is compared with: its organisation's, and itself."""
    return tenants.where(F.col("org") == org).select("tenant_id").union(own.select("tenant_id")).distinct()


def organisations(rows: DataFrame) -> DataFrame:
    """Organisations other than the one that rows without a tenant belong to."""
    return rows.select("org").where("org <> 'default'").distinct()


def shipped_scope(rows: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Objectives that calls were spent on and something was shipped for."""
    return outcomes.select("objective_id").intersect(rows.select("objective_id"))


METRICS = [
    ("cost_per_1k_tokens", False), ("cache_hit_ratio", True), ("cache_recoverable_share", False), ("orphan_share", False),
    ("net_new_share", True), ("maintenance_share", False), ("retry_rate", False), ("reuse_share", True),
]
RATIO_SENSITIVITY = 0.003
ORDER_FLOOR, MEDIAN_FLOOR = 5, 4


def tenant_vectors(rows: DataFrame, reuse: DataFrame | None = None, k: int = K) -> DataFrame:
    """Eight ratios of every tenant in one aggregate; cost ratios are null without any priced cost."""
    tenant = F.coalesce("tenant_id", F.lit("default")).alias("tenant_id")
    when = lambda cond, c: F.sum(F.when(cond, c).otherwise(0))
    g = rows.groupBy(tenant).agg(
        F.count("*").alias("n"), F.count_distinct("actor_pseudonym").alias("actors"), F.sum(A.tokens()).alias("tokens"), F.round(F.sum("cost_usd"), 6).alias("cost"),
        F.sum("cache_read_tokens").alias("cr"), F.sum("input_tokens").alias("inp"), F.sum("duplicate_history_tokens").alias("dup"), F.count_if("is_retry_loop").alias("retries"),
        when(F.col("is_orphan"), A.tokens()).alias("orphan"), F.round(when(F.col("work_type").isin(*NET_NEW), F.col("cost_usd")), 6).alias("nn"), F.round(when(F.col("work_type").isin(*MAINTENANCE), F.col("cost_usd")), 6).alias("mt"),
    )
    g = g.join(reuse, "tenant_id", "left").fillna({"avoided": 0.0}) if reuse is not None else g.withColumn("avoided", F.lit(0.0))
    priced = F.col("cost") > 0
    c = F.col
    return g.select(
        "tenant_id", "actors", (c("actors") >= k).alias("qualifies"),
        F.when(priced, ratio(c("cost"), c("tokens") / 1000.0)).alias("cost_per_1k_tokens"), ratio(c("cr"), c("cr") + c("inp")).alias("cache_hit_ratio"),
        ratio(F.greatest(c("dup") - c("cr"), F.lit(0)), c("tokens")).alias("cache_recoverable_share"), ratio(c("orphan"), c("tokens")).alias("orphan_share"),
        F.when(priced, ratio(c("nn"), c("cost"))).alias("net_new_share"), F.when(priced, ratio(c("mt"), c("cost"))).alias("maintenance_share"),
        ratio(c("retries"), c("n")).alias("retry_rate"), F.when(priced, ratio(c("avoided"), c("cost") + c("avoided"))).alias("reuse_share"),
    )


def benchmark(vectors: DataFrame, focus: str, k_tenants: int = 3, epsilon: float = EPSILON) -> DataFrame:
    """The focus tenant against its cohort, metric by metric: noised figures, percentile on the raw ones, ties half.

    Nothing comes back unless enough tenants qualify and the focus is one of them. Each metric's tenants are counted
    against the one focus value, so no pairs are formed.
    """
    names = [m for m, _ in METRICS]
    long = vectors.where("qualifies").unpivot(["tenant_id"], names, "metric", "raw").where("raw IS NOT NULL")
    noise = laplace(F.concat_ws(":", "tenant_id", "metric"), epsilon, RATIO_SENSITIVITY)
    long = long.withColumns({"noised": F.greatest(F.lit(0.0), F.col("raw") + noise), "higher": F.col("metric").isin(*[m for m, h in METRICS if h])})
    mine = long.where(F.col("tenant_id") == focus).select("metric", F.col("raw").alias("mine"), F.col("noised").alias("you"))
    joined = long.join(F.broadcast(mine), "metric", "left")
    win = F.when(F.col("higher"), F.col("mine") > F.col("raw")).otherwise(F.col("mine") < F.col("raw"))
    g = joined.groupBy("metric").agg(
        F.first("higher").alias("higher_is_better"), F.first("mine").alias("mine"), F.first("you").alias("you"), F.count("*").alias("cohort_n"), F.min("noised").alias("lo"), F.max("noised").alias("hi"),
        F.median("noised").alias("med"), F.count_if(win).alias("wins"), F.count_if(F.col("mine") == F.col("raw")).alias("ties"),
    )
    cohort = vectors.agg(F.count_if("qualifies").alias("q"), F.max(F.col("qualifies") & (F.col("tenant_id") == focus)).alias("f"))
    n = F.col("cohort_n")
    percentile = F.when(F.col("mine").isNotNull() & (n > 1), F.round((F.col("wins") + 0.5 * (F.col("ties") - 1)) / (n - 1), 4))
    ready = g.join(F.broadcast(cohort)).where((F.col("q") >= k_tenants) & F.col("f"))
    return ready.select(
        "metric", "higher_is_better", F.round("you", 6).alias("you"), "cohort_n", F.when(n >= ORDER_FLOOR, F.round("lo", 6)).alias("cohort_min"), F.when(n >= ORDER_FLOOR, F.round("hi", 6)).alias("cohort_max"),
        F.when(n >= MEDIAN_FLOOR, F.round("med", 6)).alias("cohort_median"), percentile.alias("your_percentile"),
    )


def exchange_percentiles(submissions: DataFrame, focus: str, lower_is_better: tuple[str, ...] = (), k_orgs: int = 3) -> DataFrame:
    """The focus organisation's coarse place per metric: quarter bands, never the exact ends."""
    mine = submissions.where(F.col("org") == focus).select("metric", F.col("value").alias("mine"))
    joined = submissions.join(F.broadcast(mine), "metric")
    lower = F.col("metric").isin(*lower_is_better) if lower_is_better else F.lit(False)
    below = F.count_if((F.col("value") < F.col("mine")) == ~lower)
    g = joined.groupBy("metric").agg(F.count("*").alias("cohort_orgs"), below.alias("below")).where(F.col("cohort_orgs") >= k_orgs)
    band = F.bround(F.col("below") / (F.col("cohort_orgs") - 1) * 4, 0) / 4
    return g.select("metric", "cohort_orgs", F.least(F.lit(0.9), F.greatest(F.lit(0.1), band)).alias("your_percentile"))


# The management report.
REPORT_DIMENSIONS = ("objective_label", "tool", "request_model", "provider", "work_type")


def management_report(rows: DataFrame, key: str, objectives: DataFrame | None = None, outcomes: DataFrame | None = None, period: tuple[datetime, datetime, datetime] | None = None, k: int = K) -> dict[str, DataFrame]:
    """One scope's report, block by block; ``rows`` are its daily sums (``aggregates.daily``), kept or stored before.

    Blocks: ``totals`` (one row: figures of the whole scope, noise keyed by ``key``, recoverable band, cache-hit ratio),
    ``rollups`` (five dimensions), ``trend``, ``investment``, ``new_initiatives``, ``compression``, ``routing``, ``memory``,
    and, where their inputs are given, ``budgets`` (``period``: start, end, now) and ``value``. Every figure is behind the
    gate of k people, of its own group or of the whole scope. Windows are of whole days.
    """
    total = A.totals(rows)
    shown = lambda c: F.when(F.col("actors") >= k, F.col(c)).alias(c)
    wide = total.select("actors", "unpriced", *map(shown, ("n", "tokens", "cost")), noisy(F.col("cost"), F.col("actors"), F.lit(key), k).alias("noisy_cost"), "cache_read")
    scope = F.broadcast(total.select("actors"))  # one row, as are all totals

    def gated(df: DataFrame, *columns: str) -> DataFrame:
        rest = [c for c in df.columns if c not in columns]
        return df.join(scope).select(*rest, *[withhold(F.col(c), F.col("actors"), k).alias(c) for c in columns])

    rolled = A.all_rollups(rows, REPORT_DIMENSIONS)
    out = {
        "totals": wide.join(F.broadcast(A.recoverable_band(total))).join(F.broadcast(gated(A.orphan_share(rows), "orphan_share"))),
        "rollups": rolled.select("dimension", "label", "calls", "actors", *[suppress(F.col(c), F.col("actors"), k).cast("double").alias(c) for c in ("tokens", "cost")], (F.col("actors") < k).alias("suppressed")),
        "trend": drift(rows, k),
        "investment": A.investment_split(rows, k),
        "new_initiatives": A.new_initiatives(rows, k),
        "compression": A.compression_yield(total, k),
    }
    if "route_saved_usd" in rows.columns:
        out["routing"] = gated(A.routing_totals(rows), "realised", "shadow", "routed_calls")
    if "tm_tier" in rows.columns:
        out["memory"] = gated(A.memory_totals(rows), "calls", "shadow_usd")
    if objectives is not None and period is not None:
        start, end, now = period
        out["budgets"] = budget_status(rows, objectives, start, end, now, k, gated=True)
    if outcomes is not None:
        value = A.value_line(rows, outcomes, total.select("cost"))
        out["value"] = gated(value, *value.columns)
    return out


def as_lines(report: dict[str, DataFrame], labels: dict[str, list[str]]) -> DataFrame:
    """A report's blocks in one table: ``block``, ``label`` (the block's label columns, joined), ``metric``, ``value`` (flags are 0 and 1)."""
    parts = []
    for block, df in report.items():
        own = labels.get(block, [])
        kinds = dict(df.dtypes)
        metrics = [c for c in df.columns if c not in own and kinds[c] != "string"]
        pairs = F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in metrics])
        parts.append(df.select(F.lit(block).alias("block"), F.concat_ws("|", *own).alias("label") if own else F.lit("").alias("label"), F.explode(pairs).alias("x")).select("block", "label", "x.metric", "x.value"))
    return reduce(DataFrame.unionByName, parts)
