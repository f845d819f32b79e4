"""Aggregates over the fact table. Tenant None means all; ``default`` also holds rows without a tenant."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.columns import investment, ratio
from ..functions.privacy import K, noisy, withhold

ROLLUPS = ("objective_label", "tool", "request_model", "provider", "tier", "work_type")


def tokens() -> Column:
    return F.coalesce(F.col("input_tokens"), F.lit(0)) + F.coalesce(F.col("output_tokens"), F.lit(0))


def for_tenant(rows: DataFrame, tenant: str | None) -> DataFrame:
    if tenant is None:
        return rows
    return rows.where(F.coalesce("tenant_id", F.lit("default")) == tenant)


def own_rows(rows: DataFrame, pseudonym: str) -> DataFrame:
    return rows.where(F.col("actor_pseudonym") == pseudonym)


def in_window(rows: DataFrame, start: datetime | None = None, end: datetime | None = None, inclusive: bool = False) -> DataFrame:
    """Half-open; ``inclusive`` moves the end a second on, so that a row stamped exactly then is in."""
    if start is not None:
        rows = rows.where(F.col("ts") >= F.lit(start))
    if end is not None:
        rows = rows.where(F.col("ts") < F.lit(end) + F.expr("interval 1 second") if inclusive else F.col("ts") < F.lit(end))
    return rows


def _sum(c: str) -> Column:
    return F.coalesce(F.sum(c), F.lit(0))


def money(c: Column) -> Column:
    """To four digits; the nudge keeps halves from falling either way with the order of a sum."""
    return F.round(F.coalesce(c, F.lit(0.0)) + 1e-9, 4)


def micros(c: str = "ts") -> Column:
    return F.unix_micros(F.col(c).cast("timestamp"))


#: What a day's partial sums keep apart, where the rows have it.
DAILY_KEYS = ("tenant_id", "actor_pseudonym", "objective_id", "objective_label", "is_orphan", "work_type", "tool", "request_model", "provider", "tier", "tm_tier")
DAILY_SUMS = ("input_tokens", "output_tokens", "cost_usd", "duplicate_history_tokens", "cache_read_tokens", "cache_creation_tokens", "saved_input_tokens", "route_saved_usd", "route_shadow_usd", "tm_shadow_usd")
#: Counts of rows with a flag, by the flag's column.
DAILY_COUNTS = {"is_retry_loop": F.col, "served_from_cache": F.col, "cost_priced": lambda c: ~F.col(c), "route_target": lambda c: F.col(c).isNotNull()}


def daily(rows: DataFrame) -> DataFrame:
    """Partial sums by day, person and label: what reports read instead of the rows.

    Columns are named as the rows' own, with ``calls`` and ``n_<flag>`` for counts, so that the aggregates here take
    either. Sums of sums are sums, and people stay people, so days can be appended and any windows of whole days read.
    """
    have = set(rows.columns)
    keys = [c for c in DAILY_KEYS if c in have]
    sums = [F.sum(c).alias(c) for c in DAILY_SUMS if c in have]
    counts = [F.count_if(flag(c)).alias(f"n_{c}") for c, flag in DAILY_COUNTS.items() if c in have]
    return rows.withColumn("ts", F.date_trunc("day", "ts")).groupBy("ts", *keys).agg(F.count("*").alias("calls"), *sums, *counts)


def calls_of(rows: DataFrame, only: Column | None = None) -> Column:
    """The number of calls, of rows or of daily sums; ``only``: where that holds."""
    n = F.col("calls") if "calls" in rows.columns else F.lit(1)
    return F.coalesce(F.sum(n if only is None else F.when(only, n)), F.lit(0)).cast("long")


def flagged(rows: DataFrame, flag: str) -> Column:
    """How many calls have a flag, see ``DAILY_COUNTS``."""
    if f"n_{flag}" in rows.columns:
        return F.coalesce(F.sum(f"n_{flag}"), F.lit(0))
    return F.count_if(DAILY_COUNTS[flag](flag))


def totals(rows: DataFrame) -> DataFrame:
    return rows.agg(
        calls_of(rows).alias("n"),
        F.coalesce(F.sum(tokens()), F.lit(0)).alias("tokens"),
        money(F.sum("cost_usd")).alias("cost"),
        F.count_distinct("actor_pseudonym").alias("actors"),
        _sum("duplicate_history_tokens").alias("dup_tokens"),
        _sum("cache_read_tokens").alias("cache_read"),
        _sum("cache_creation_tokens").alias("cache_creation"),
        _sum("input_tokens").alias("input_tokens"),
        flagged(rows, "is_retry_loop").alias("retries"),
        flagged(rows, "cost_priced").alias("unpriced"),
        _sum("saved_input_tokens").alias("saved_tokens"),
        flagged(rows, "served_from_cache").alias("cache_hits"),
    )


def rollup(rows: DataFrame, dimension: str, by: list[str] | None = None) -> DataFrame:
    if dimension not in ROLLUPS:
        raise ValueError(f"no rollup by {dimension!r}; there are {', '.join(ROLLUPS)}")
    label = F.coalesce(F.col(dimension), F.lit("(unattributed)")).alias("label")
    return rows.groupBy(*(by or []), label).agg(
        calls_of(rows).alias("calls"), F.sum(tokens()).alias("tokens"), money(F.sum("cost_usd")).alias("cost"), F.count_distinct("actor_pseudonym").alias("actors")
    )


def all_rollups(rows: DataFrame, dimensions: tuple[str, ...] = ("objective_label", "tool", "request_model", "provider", "work_type")) -> DataFrame:
    """Every one-dimension rollup from one scan: (dimension, label, calls, tokens, cost, actors).

    Rows are dealt by person once; a person's sums by label are made where the rows lie, and only sums by label go on.
    """
    labels = F.array(*[F.struct(F.lit(d).alias("dimension"), F.coalesce(F.col(d), F.lit("(unattributed)")).alias("label")) for d in dimensions])
    base = rows.select(*dimensions, tokens().alias("tokens"), "cost_usd", "actor_pseudonym", (F.col("calls") if "calls" in rows.columns else F.lit(1)).alias("calls")).repartition("actor_pseudonym")
    each = base.select("actor_pseudonym", "calls", "tokens", "cost_usd", F.explode(labels).alias("of"))
    people = each.groupBy("actor_pseudonym", F.col("of.dimension").alias("dimension"), F.col("of.label").alias("label")).agg(F.sum("calls").alias("calls"), F.sum("tokens").alias("tokens"), F.sum("cost_usd").alias("cost"))
    return people.groupBy("dimension", "label").agg(F.sum("calls").alias("calls"), F.sum("tokens").alias("tokens"), money(F.sum("cost")).alias("cost"), F.count("actor_pseudonym").alias("actors"))


def tickets(rows: DataFrame) -> DataFrame:
    return rows.where("ticket_id IS NOT NULL").groupBy("ticket_id", "work_type", "objective_label").agg(
        F.count("*").alias("calls"), F.sum(tokens()).alias("tokens"), money(F.sum("cost_usd")).alias("cost"), F.count_distinct("actor_pseudonym").alias("actors")
    )


def orphan_share(rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    return rows.groupBy(*(by or [])).agg(ratio(F.sum(F.when(F.col("is_orphan"), tokens()).otherwise(0)), F.sum(tokens())).alias("orphan_share"))


def window_stats(rows: DataFrame, windows: dict[str, tuple[datetime, datetime]]) -> DataFrame:
    """Several half-open windows in one pass by conditional sums: one row for each."""
    named = F.explode(F.array(*[F.struct(F.lit(n).alias("window"), F.lit(a).alias("a"), F.lit(b).alias("b")) for n, (a, b) in windows.items()])).alias("w")
    return rows.select("*", named).where("ts >= w.a AND ts < w.b").groupBy("w.window").agg(*_window_aggs())


def _window_aggs() -> list[Column]:
    orphan = F.sum(F.when(F.col("is_orphan"), tokens()).otherwise(0))
    return [
        F.count("*").alias("events"), F.count_distinct("actor_pseudonym").alias("actors"), F.sum(tokens()).alias("tokens"),
        money(F.sum("cost_usd")).alias("cost"), orphan.alias("orphan_tokens"), ratio(orphan, F.sum(tokens())).alias("orphan_share"),
    ]


def objective_spend(rows: DataFrame) -> DataFrame:
    """Spend and people of each objective: what budgets and their gates need, in one aggregate."""
    return rows.where("objective_id IS NOT NULL").groupBy("objective_id").agg(money(F.sum("cost_usd")).alias("spent"), F.count_distinct("actor_pseudonym").alias("actors"))


def time_bounds(rows: DataFrame) -> DataFrame:
    return rows.agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


def actor_costs(rows: DataFrame) -> DataFrame:
    """Non-zero spend of each person on each (tenant, objective, work type)."""
    w = F.coalesce("work_type", F.lit("unknown")).alias("work_type")
    by = rows.where("objective_id IS NOT NULL AND actor_pseudonym IS NOT NULL").groupBy("tenant_id", "objective_id", w, "actor_pseudonym").agg(F.round(F.sum("cost_usd"), 6).alias("cost"))
    return by.where("cost > 0")


def distinct_scope(rows: DataFrame, columns: tuple[str, ...] = ("tenant_id", "objective_id")) -> DataFrame:
    """The scopes that have calls."""
    return rows.select(*columns).distinct()


def work_mix(rows: DataFrame) -> DataFrame:
    """Calls, tokens and cost of each person's work types."""
    return rows.groupBy("actor_pseudonym", "work_type").agg(calls_of(rows).alias("calls"), F.sum(tokens()).alias("tokens"), money(F.sum("cost_usd")).alias("cost"))


def work_graph(rows: DataFrame, terms: DataFrame | None = None) -> DataFrame:
    """Everyone's personal work graph, counts only; ``terms`` (actor_pseudonym, term): their learned vocabulary."""
    d = F.count_distinct
    own = rows.groupBy("actor_pseudonym").agg(
        calls_of(rows).alias("calls"), F.sum(tokens()).alias("tokens"), money(F.sum("cost_usd")).alias("cost"),
        d("objective_id").alias("objectives"), d("ticket_id").alias("tickets"), d("tool").alias("tools"), d("request_model").alias("models"),
    )
    if terms is None:
        return own
    words = terms.groupBy("actor_pseudonym").agg(d("term").alias("learned_terms"))
    return own.join(words, "actor_pseudonym", "left").fillna({"learned_terms": 0})


def dominant_work_type(rows: DataFrame, key: str = "objective_label") -> DataFrame:
    """Each key's work type of the most cost; of equal ones the greatest name."""
    per = rows.where(F.col(key).isNotNull()).groupBy(key, "work_type").agg(F.round(F.sum("cost_usd"), 6).alias("c"))
    return per.groupBy(key).agg(F.max_by("work_type", F.struct("c", "work_type")).alias("work_type"))


def by_month(rows: DataFrame) -> DataFrame:
    """Calls of each calendar month, with its bounds (the end is the next month's start)."""
    start = F.date_trunc("month", F.col("ts").cast("timestamp"))
    end = start + F.expr("interval 1 month")
    return rows.groupBy(start.cast("timestamp_ntz").alias("month_start"), end.cast("timestamp_ntz").alias("month_end")).agg(calls_of(rows).alias("calls"))


def top_labels(rolled: DataFrame, n: int, k: int = K) -> DataFrame:
    """A rollup's dearest labels with enough people, by cost, then name."""
    return rolled.where(F.col("actors") >= k).orderBy(F.desc("cost"), "label").limit(n)


def actor_summary(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count("*").alias("calls"), F.coalesce(F.sum(tokens()), F.lit(0)).alias("tokens"), money(F.sum("cost_usd")).alias("cost"), F.count_if("is_retry_loop").alias("retries"), _sum("duplicate_history_tokens").alias("dup_tokens"))


def map_totals(rows: DataFrame, column: str) -> DataFrame:
    """Sums of a map column by key."""
    return rows.select(F.explode(column).alias("strategy", "value")).groupBy("strategy").agg(F.sum("value").alias("total"))


def outcome_totals(outcomes: DataFrame) -> DataFrame:
    return outcomes.groupBy("objective_id").agg(
        F.count("*").alias("changes"), F.count_if("merged").alias("merged"), F.count_if("reverted").alias("reverted"),
        F.sum("lines_added").alias("lines_added"), F.sum("lines_removed").alias("lines_removed"),
    )


def investment_split(rows: DataFrame, k: int = K) -> DataFrame:
    """Spend on new things, upkeep and the rest, from work types that enough people did."""
    kept = rollup(rows, "work_type").where(F.col("actors") >= k)
    return kept.groupBy(investment(F.col("label")).alias("kind")).agg(money(F.sum("cost")).alias("cost"), F.sum("tokens").alias("tokens"))


def new_initiatives(rows: DataFrame, k: int = K) -> DataFrame:
    """Objectives whose first activity is in the later half of the time range, with their dominant work type by cost."""
    bounds = rows.agg(F.min(micros()).alias("lo"), F.max(micros()).alias("hi"))
    per = rows.where("objective_label IS NOT NULL").groupBy("objective_label", "work_type").agg(F.sum("cost_usd").alias("c"), F.min(micros()).alias("t"))
    people = rows.where("objective_label IS NOT NULL").groupBy("objective_label").agg(F.count_distinct("actor_pseudonym").alias("actors"))
    each = per.groupBy("objective_label").agg(F.min("t").alias("t"), F.sum("c").alias("c"), F.max_by("work_type", F.struct(F.round("c", 6), "work_type")).alias("work_type"))
    late = each.join(F.broadcast(bounds)).where(F.col("t") >= (F.col("lo") + F.col("hi")) / 2).join(people, "objective_label")
    return late.select("objective_label", "actors", withhold(money(F.col("c")), F.col("actors"), k).alias("cost"), "work_type")


def value_line(rows: DataFrame, outcomes: DataFrame, tenant_cost: DataFrame) -> DataFrame:
    """Shipped changes of the objectives that the rows spent on, over the whole cost and over those objectives' cost."""
    spent = rows.where("objective_id IS NOT NULL").select("objective_id").distinct()
    shipped = outcomes.join(spent, "objective_id", "left_semi")
    matched = rows.join(shipped.select("objective_id").distinct(), "objective_id", "left_semi").agg(F.coalesce(F.sum("cost_usd"), F.lit(0.0)).alias("matched_cost"))
    o = shipped.agg(F.count("*").alias("changes"), F.count_if("merged").alias("merged"), F.count_if("reverted").alias("reverted"), F.coalesce(F.sum(F.col("lines_added") - F.col("lines_removed")), F.lit(0)).alias("net_lines"))
    return o.join(F.broadcast(tenant_cost)).join(F.broadcast(matched)).select(
        "changes", "merged", "reverted", "net_lines", ratio(F.col("merged"), F.col("changes"), 4).alias("merge_rate"), ratio(F.col("reverted"), F.col("merged"), 4).alias("revert_rate"),
        ratio(F.col("cost"), F.col("merged"), 4).alias("cost_per_merged_change"), ratio(F.col("matched_cost"), F.col("merged"), 4).alias("matched_cost_per_merged_change"),
    )


def recoverable_band(total: DataFrame) -> DataFrame:
    """What resent history would save at the blended rate (floor: a tenth), and the cache-hit ratio, from ``totals``."""
    billed = F.col("tokens") + F.col("cache_read") + F.col("cache_creation")
    ceiling = F.greatest(F.col("dup_tokens") - F.col("cache_read"), F.lit(0)) * F.coalesce(F.try_divide(F.col("cost"), billed.cast("double")), F.lit(0.0))
    return total.select(F.round(ceiling, 4).alias("ceiling_usd"), F.round(ceiling * 0.1, 4).alias("floor_usd"), ratio(F.col("cache_read"), F.col("cache_read") + F.col("input_tokens"), 4).alias("cache_hit_ratio"))


def compression_yield(total: DataFrame, k: int = K) -> DataFrame:
    rate = F.coalesce(F.try_divide(F.col("cost"), F.col("tokens").cast("double")), F.lit(0.0))
    return total.select(
        withhold(F.col("saved_tokens"), F.col("actors"), k).alias("saved_tokens"),
        withhold(F.round(F.col("saved_tokens") * rate, 4), F.col("actors"), k).alias("saved_usd"),
        withhold(F.col("cache_hits"), F.col("actors"), k).alias("cache_hits"),
    )


def routing_totals(rows: DataFrame) -> DataFrame:
    return rows.agg(money(F.sum("route_saved_usd")).alias("realised"), money(F.sum("route_shadow_usd")).alias("shadow"), flagged(rows, "route_target").alias("routed_calls"))


def memory_totals(rows: DataFrame) -> DataFrame:
    return rows.where("tm_tier IS NOT NULL").groupBy("tm_tier").agg(calls_of(rows).alias("calls"), money(F.sum("tm_shadow_usd")).alias("shadow_usd"))


def _savings(rows: DataFrame) -> list[Column]:
    out = [money(F.sum("route_saved_usd")).alias("realised"), money(F.sum("route_shadow_usd")).alias("shadow"), flagged(rows, "route_target").alias("routed_calls")]
    if "tm_tier" in rows.columns:
        out += [calls_of(rows, F.col("tm_tier") == t).alias(n) for t, n in (("serve", "serve_hits"), ("warm_start", "warm_starts"))] + [money(F.sum("tm_shadow_usd")).alias("memory_shadow")]
    return out


def actor_savings(rows: DataFrame) -> DataFrame:
    """Each person's savings: by routing, realised and possible, and what team memory would have saved."""
    return rows.groupBy("actor_pseudonym").agg(*_savings(rows))


def developer_report(rows: DataFrame) -> DataFrame:
    """Every person's own summary, one row each: use, cache, resent history, savings, and the mix of work types.

    ``work_type_mix`` is an array of (label, calls, cost), dearest first. One aggregate by person and work type, and one
    of those by person; rows or daily sums.
    """
    label = F.coalesce("work_type", F.lit("unknown")).alias("label")
    measures = {
        "calls": calls_of(rows), "tokens": F.sum(tokens()), "cost": F.sum("cost_usd"), "retries": flagged(rows, "is_retry_loop"), "dup_tokens": F.sum("duplicate_history_tokens"),
        "cache_read_tokens": _sum("cache_read_tokens"), "input_tokens": _sum("input_tokens"), "realised": F.sum("route_saved_usd"), "shadow": F.sum("route_shadow_usd"), "routed_calls": flagged(rows, "route_target"),
    }
    if "tm_tier" in rows.columns:
        measures |= {"serve_hits": calls_of(rows, F.col("tm_tier") == "serve"), "warm_starts": calls_of(rows, F.col("tm_tier") == "warm_start"), "memory_shadow": F.sum("tm_shadow_usd")}
    per = rows.groupBy("actor_pseudonym", label).agg(*[c.alias(n) for n, c in measures.items()])
    usd = ("cost", "realised", "shadow", "memory_shadow")
    mix = F.transform(F.array_sort(F.collect_list(F.struct(F.negate(money(F.col("cost"))).alias("o"), "label", "calls"))), lambda x: F.struct(x["label"].alias("label"), x["calls"].alias("calls"), F.negate(x["o"]).alias("cost")))
    own = per.groupBy("actor_pseudonym").agg(*[(money(F.sum(n)) if n in usd else F.sum(n)).alias(n) for n in measures], mix.alias("work_type_mix"))
    uncached = F.greatest(F.col("dup_tokens") - F.col("cache_read_tokens"), F.lit(0)).alias("uncached_resent_tokens")
    return own.select("*", ratio(F.col("cache_read_tokens"), F.col("cache_read_tokens") + F.col("input_tokens"), 4).alias("cache_hit_ratio"), uncached)


def noisy_total(rows: DataFrame, name: str, k: int = K) -> DataFrame:
    return rows.agg(F.round(F.sum("cost_usd"), 4).alias("c"), F.count_distinct("actor_pseudonym").alias("actors")).select(noisy(F.col("c"), F.col("actors"), F.lit(name), k).alias("noisy_cost"))


def burn_today(rows: DataFrame, now: datetime) -> DataFrame:
    """Spend since midnight over the elapsed share of the day (at least 0.04)."""
    midnight = now.replace(hour=0, minute=0, second=0, microsecond=0)
    share = max((now - midnight).total_seconds() / 86400, 0.04)
    return in_window(rows, midnight, now, inclusive=True).agg(money(F.sum("cost_usd")).alias("spent"), money(F.sum("cost_usd") / share).alias("burn_rate"))


def recent_calls(rows: DataFrame, n: int = 20, by_cost: bool = False, objective: str | None = None) -> DataFrame:
    if objective is not None:
        rows = rows.where(F.col("objective_id") == objective)
    order = [F.desc("cost_usd")] if by_cost else [F.desc("ts")]
    return rows.orderBy(*order, "event_id").limit(n)


def latest_per(rows: DataFrame, key: str, n: int, order: list[Column]) -> DataFrame:
    """The latest ``n`` rows of every key."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("rank") <= n)
