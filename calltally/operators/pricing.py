"""Pricing: longest-prefix match of a model's family name; costs are column arithmetic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.dims import local_table


def normal_model(model: Column) -> Column:
    """A model's family name: routing prefixes off, in a fixed order."""
    return F.regexp_replace(_unrouted(model), f"^{_REGIONS}", "")


#: Each region once, in this order; never given back for a longer match.
_REGIONS = "".join(rf"(?:{r}\.)?+" for r in ("us", "eu", "apac"))


def _unrouted(model: Column) -> Column:
    m = F.substring_index(F.lower(F.trim(model)), "/", -1)
    for part in ("anthropic.", "google.", "openai."):
        m = F.replace(m, F.lit(part), F.lit(""))
    return m


def match_prices(models: DataFrame, prices: DataFrame, model_col: str = "request_model") -> DataFrame:
    """Distinct models with their price columns; the longest key that a model's name starts with wins.

    The prefix join sees each model once, so it costs models times prices (21 rows), however many calls there are.
    """
    distinct = models.select(F.col(model_col).alias("model")).where("model IS NOT NULL").distinct().withColumn("_norm", normal_model(F.col("model")))
    joined = distinct.join(F.broadcast(prices), F.col("_norm").startswith(F.col("price_key")))
    best = F.max_by(F.struct(*prices.columns), F.length("price_key")).alias("p")
    return joined.groupBy("model").agg(best).select("model", "p.*")


#: Up to so many prices are matched by one pattern over the calls themselves and joined as a broadcast.
MAX_PRICE_ROWS = 1000


def with_prices(calls: DataFrame, prices: DataFrame, model_col: str = "request_model", prefix: str = "") -> DataFrame:
    """``calls`` with their price columns (null: unpriced). Longer tables of prices are joined through the distinct models."""
    rows = prices.limit(MAX_PRICE_ROWS + 1).collect()
    if len(rows) > MAX_PRICE_ROWS:
        matched = match_prices(calls, prices, model_col)
        matched = matched.select(F.col("model").alias(f"{prefix}model"), *[F.col(c).alias(prefix + c) for c in prices.columns])
        return calls.join(matched, calls[model_col] == F.col(f"{prefix}model"), "left").drop(f"{prefix}model")
    first = {r["price_key"]: r for r in reversed(rows)}
    known = local_table(calls.sparkSession, first.values(), prices.schema).select(F.col("price_key").alias("_key"), *[F.col(c).alias(prefix + c) for c in prices.columns])
    # The first branch that fits is taken: longest first.
    longest = f"^{_REGIONS}(" + "|".join(rf"\Q{k}\E" for k in sorted(first, key=len, reverse=True)) + ")"
    keyed = calls.withColumn("_match", F.regexp_extract(_unrouted(F.col(model_col)), longest, 1))
    return keyed.join(F.broadcast(known), F.col("_match") == F.col("_key"), "left").drop("_match", "_key")


def usd(x: Column) -> Column:
    """Money to six digits; the nudge keeps halves from falling either way with the engine's rounding."""
    return F.round(x + 1e-12, 6)


def cost(prefix: str = "") -> Column:
    """Fresh input, output, cache reads and cache writes of a priced call; 0 for an unpriced one."""
    p = lambda c: F.col(prefix + c)
    m = 1_000_000
    total = F.col("input_tokens") / m * p("p_input") + F.col("output_tokens") / m * p("p_output")
    total = total + (F.col("cache_read_tokens") / m * p("p_cache_read") + F.col("cache_creation_tokens") / m * p("p_cache_write"))
    return F.coalesce(usd(total), F.lit(0.0))


def price_calls(calls: DataFrame, prices: DataFrame) -> DataFrame:
    """``cost_usd``, ``cost_priced`` and ``cache_saving_usd`` (what resent context would save as cache reads)."""
    return costed(with_prices(calls, prices), prices)


def costed(priced: DataFrame, prices: DataFrame) -> DataFrame:
    """The same of calls that have their price columns already."""
    resent = F.greatest(F.col("duplicate_history_tokens") - F.col("cache_read_tokens"), F.lit(0))
    saving = F.coalesce(usd(resent * F.greatest(F.lit(0.0), F.col("p_input") - F.col("p_cache_read")) / 1_000_000), F.lit(0.0))
    return priced.withColumns({"cost_usd": cost(), "cost_priced": F.col("price_key").isNotNull(), "cache_saving_usd": saving}).drop(*prices.columns)


#: Cheaper model of each provider, and marks of models strong enough to route down from (fixed values).
CHEAP = {"anthropic": "claude-haiku-4-5", "openai": "gpt-4o-mini", "google": "gemini-2.5-flash"}
STRONG = ("opus", "sonnet", "gpt-4o", "gpt-4.1", "gpt-5", "gemini-2.5-pro")
DIFFICULTY_CEILING = 0.15


def with_both_prices(calls: DataFrame, prices: DataFrame, model_col: str) -> DataFrame:
    """Prices of ``model_col`` (``a_``) and ``route_target`` (``b_``) where there is a target; other calls save nothing, and no name is looked up for them."""
    routed = calls.withColumn("_routed", F.when(F.col("route_target").isNotNull(), F.col(model_col)))
    return with_prices(with_prices(routed, prices, "_routed", "a_"), prices, "route_target", "b_").drop("_routed")


def route_calls(calls: DataFrame, prices: DataFrame, cheap: dict[str, str] = CHEAP) -> DataFrame:
    """``difficulty``, ``route_target`` and ``route_saving_usd`` of each call on its own tokens.

    Difficulty is 1 with tools or a large body; else 0.5, less 0.4 for an easy phrase, 0.2 for a short prompt and 0.2 for
    a small output limit. Only strong models with a cheaper one are routed.
    """
    hard = F.col("has_tools") | (F.col("body_chars") > 8000)
    ease = F.when(F.col("easy_phrase"), 0.4).otherwise(0.0) + F.when(F.col("prompt_chars") < 200, 0.2).otherwise(0.0) + F.when(F.coalesce(F.col("max_tokens") <= 512, F.lit(False)), 0.2).otherwise(0.0)
    difficulty = F.when(hard, 1.0).otherwise(F.greatest(F.lit(0.0), F.round(0.5 - ease, 6)))
    strong = F.lit(False)
    for mark in STRONG:
        strong = strong | F.lower("request_model").contains(mark)
    target = F.when(F.lit(False), "")
    for provider, model in cheap.items():
        target = target.when(F.col("provider") == provider, model)
    out = calls.withColumn("difficulty", difficulty)
    out = out.withColumn("route_target", F.when(strong & (F.col("difficulty") <= DIFFICULTY_CEILING) & (target != F.col("request_model")), target))
    out = with_both_prices(out, prices, "request_model")
    saving = F.when(F.col("route_target").isNotNull(), F.greatest(F.lit(0.0), usd(cost("a_") - cost("b_")))).otherwise(0.0)
    return out.withColumn("route_saving_usd", saving).drop(*[x + c for x in ("a_", "b_") for c in prices.columns])
