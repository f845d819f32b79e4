"""Waste signals over ordered conversations and prompts."""

from __future__ import annotations

import difflib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions.columns import token_estimate
from .sizes import kept

RETRY_BAR, RETRY_BACK = 0.92, 4
ANSWERED_BAR, ANSWERED_BACK = 0.85, 100
UNCACHED_MIN, BLOAT_SHARE, CHEAP_TOKENS = 2000, 0.6, 350


def conversation_requests(turns: DataFrame) -> DataFrame:
    """Each user turn as a request that carries the whole conversation up to it."""
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    messages = F.collect_list(F.struct("role", F.coalesce("text", F.lit("")).alias("text"))).over(w)
    return turns.withColumn("messages", messages).where("role = 'user'").select("conv_id", "turn", "messages")


def resent_history(requests: DataFrame) -> DataFrame:
    """Tokens of the leading run of messages that the conversation's previous request had too."""
    prints = F.transform("messages", lambda m: F.sha2(F.concat_ws(":", m["role"], m["text"]), 256))
    w = Window.partitionBy("conv_id").orderBy("turn")
    out = requests.withColumn("fp", prints).withColumn("before", F.lag("fp").over(w))
    same = F.zip_with("fp", F.coalesce("before", F.array().cast("array<string>")), lambda a, b: F.coalesce(a == b, F.lit(False)))
    first = F.array_position(same, F.lit(False))
    run = F.when(first > 0, first - 1).otherwise(F.size(same)).cast("int")
    spent = F.aggregate(F.slice("messages", F.lit(1), run), F.lit(0).cast("long"), lambda a, m: a + token_estimate(m["text"]))
    total = F.aggregate("messages", F.lit(0).cast("long"), lambda a, m: a + token_estimate(m["text"]))
    return out.select("conv_id", "turn", run.alias("resent_messages"), spent.alias("dup_tokens"), total.alias("input_tokens"))


def resend_signal(rows: DataFrame) -> DataFrame:
    """``signal``: cache inefficiency, else context bloat, else a hint that a cheap model would do."""
    dup, read = F.col("duplicate_history_tokens"), F.col("cache_read_tokens")
    used = F.col("input_tokens") + F.col("output_tokens")
    s = (
        F.when((dup - read >= UNCACHED_MIN) & (read < dup / 2), "cache_inefficiency")
        .when((F.col("input_tokens") > 0) & (dup / F.col("input_tokens") >= BLOAT_SHARE), "context_bloat")
        .when((used > 0) & (used <= CHEAP_TOKENS) & ~F.col("is_retry_loop"), "routing_hint")
    )
    return rows.withColumn("signal", s)


def jaccard(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)).cast("double"), F.size(F.array_union(a, b)).cast("double")), F.lit(0.0))


@F.pandas_udf(T.DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([difflib.SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)])


def numbered(rows: DataFrame, key: str, order: list[str], flag: Column, bucket: Column) -> DataFrame:
    """``rows`` with ``before``: how many earlier rows of ``key`` (by ``order``) have ``flag``, and ``k``, the row's own number if it has.

    ``bucket`` ascends with the order. Buckets are numbered by themselves and moved up by the counts of those before, so
    a key with most rows is many windows of its buckets and one of its buckets' counts.
    """
    flagged = rows.withColumns({"_b": bucket, "_f": F.coalesce(flag, F.lit(False)).cast("long")})
    w = Window.partitionBy(key, "_b").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    counts = flagged.groupBy(key, "_b").agg(F.sum("_f").alias("_n"))
    up = counts.select(F.col(key).alias("_key"), F.col("_b").alias("_bucket"), F.coalesce(F.sum("_n").over(Window.partitionBy(key).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_up"))
    out = flagged.withColumn("_in", F.coalesce(F.sum("_f").over(w), F.lit(0)))
    out = out.join(up, out[key].eqNullSafe(up["_key"]) & out["_b"].eqNullSafe(up["_bucket"]))
    before = F.col("_in") + F.col("_up")
    return out.select(*rows.columns, before.alias("before"), F.when(F.col("_f") == 1, before + 1).alias("k"))


def prefix_length(size: Column, bar: float) -> Column:
    """So many of a set's rarest words that two sets with a Jaccard of ``bar`` share one of them."""
    return (size - F.ceil(size * bar - 1e-9) + 1).cast("int")


def similar_before(prompts: DataFrame, back: int, bar: float, ratio=sequence_ratio, answered: Column | None = None, bucket: Column | None = None, apart=None) -> DataFrame:
    """Prompts like one of the actor's last ``back`` (of the ``answered`` ones, if given): half token Jaccard, half ``ratio``.

    The Jaccard half bounds the whole, so pairs below ``2 * bar - 1`` are left out. They are found by ids: each prompt's
    rarest words, as many as two such prompts must share one of, meet those of the actor's prompts in the two blocks of
    ``back`` that the last ``back`` lie in. Texts are joined to what is left, for ``ratio`` (pluggable). Prompts
    without a word are like none. ``apart`` gives one less the ratio instead, and is taken off last, as in SQL: a pair
    right at the bar falls to either side with the order of the sum. (ts, event_id) order an actor's prompts; ``bucket`` cuts that order, see ``numbered``.
    """
    least, taught = 2 * bar - 1, F.lit(True) if answered is None else answered
    words = F.array_distinct(F.regexp_extract_all(F.lower("prompt"), F.lit("[a-z0-9_]+"), F.lit(0)))
    base = prompts.select("actor", "ts", "event_id", F.transform(words, lambda w: F.xxhash64(w)).alias("words"), taught.alias("_taught"))
    at = numbered(base, "actor", ["ts", "event_id"], F.col("_taught"), F.lit(0) if bucket is None else bucket)
    at = at.select("actor", "ts", "event_id", "words", "before", "k", F.size("words").alias("n")).where("n > 0")
    every = at.select("actor", "ts", "event_id", "before", "k", "n", F.explode("words").alias("w"))
    rarity = every.groupBy("w").agg(F.count("*").alias("df"))
    ranked = every.join(rarity, "w").groupBy("actor", "ts", "event_id", "before", "k", "n").agg(F.array_sort(F.collect_list(F.struct("df", "w"))).alias("by"))
    rare = ranked.select("actor", "ts", "event_id", "before", "k", "n", F.explode(F.slice(F.col("by.w"), F.lit(1), prefix_length(F.col("n"), least))).alias("w"))
    block = lambda c: F.floor((c - 1) / F.lit(back)).cast("long")
    asks = rare.where("before > 0").select("actor", "w", F.explode(F.array_distinct(F.array(block(F.col("before")), block(F.greatest(F.col("before") - back + 1, F.lit(1)))))).alias("block"), F.col("ts").alias("ts_a"), F.col("event_id").alias("id_a"), "before", F.col("n").alias("n_a"))
    holds = rare.where("k IS NOT NULL").select("actor", "w", block(F.col("k")).alias("block"), F.col("ts").alias("ts_b"), F.col("event_id").alias("id_b"), "k", F.col("n").alias("n_b"))
    near = (F.col("k") <= F.col("before")) & (F.col("k") > F.col("before") - back) & (F.least("n_a", "n_b") >= F.greatest("n_a", "n_b") * least - 1e-9)
    ids = asks.join(holds, ["actor", "w", "block"]).where(near).select("actor", "ts_a", "id_a", "ts_b", "id_b").distinct()
    known = lambda x: at.select("actor", F.col("ts").alias(f"ts_{x}"), F.col("event_id").alias(f"id_{x}"), F.col("words").alias(f"words_{x}"))
    scored = ids.join(known("a"), ["actor", "ts_a", "id_a"]).join(known("b"), ["actor", "ts_b", "id_b"]).withColumn("j", jaccard(F.col("words_a"), F.col("words_b"))).where(F.col("j") >= least)
    text = lambda x: prompts.select("actor", F.col("ts").alias(f"ts_{x}"), F.col("event_id").alias(f"id_{x}"), F.lower("prompt").alias(f"text_{x}"))
    pairs = scored.select("actor", "ts_a", "id_a", "ts_b", "id_b", "j").join(text("a"), ["actor", "ts_a", "id_a"]).join(text("b"), ["actor", "ts_b", "id_b"])
    both = F.col("j") + ratio(F.col("text_a"), F.col("text_b")) if apart is None else F.col("j") + 1 - apart(F.col("text_a"), F.col("text_b"))
    best = pairs.withColumn("sim", both / 2).where(F.col("sim") >= bar)
    return best.groupBy("actor", F.col("id_a").alias("event_id")).agg(F.round(F.max("sim"), 4).alias("similarity"))


def edit_ratio(a: Column, b: Column) -> Column:
    """One less the share of characters to edit: a similarity that needs no Python."""
    return 1 - edit_share(a, b)


def edit_share(a: Column, b: Column) -> Column:
    return F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b), F.lit(1))


#: Seconds of a block of time, in TTLs.
BLOCK_TTLS = 64


def _anchors(times: np.ndarray, start: np.ndarray, ttl: int) -> np.ndarray:
    """Which of the ascending ``times`` are anchors if the one at ``start`` is the first: each next is the first beyond the TTL."""
    after, i, out = np.searchsorted(times, times + ttl, "right"), int(start), np.zeros(len(times), bool)
    while i < len(times):
        out[i] = True
        i = int(after[i])
    return out


def exact_repeats(log: DataFrame, ttl_seconds: int = 300) -> DataFrame:
    """Calls that an exact cache would have served: within the TTL of the *stored* call of the same key; hits don't renew.

    Which calls are stored depends on all before them. A key's time is cut into blocks, which are tasks of their own:
    each tells, for every call that might be its first stored one (those within a TTL of its start, and its first), the
    last stored one. Joined to the next block, these are pointers from block to block; doubling them marks, in as many
    rounds as the number of blocks has bits, the call that each block does start with. Then blocks run once more. Calls
    at one time: the first by event id may be stored.
    """
    spark, ttl = log.sparkSession, ttl_seconds * 1_000_000
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    key = F.sha2(F.concat_ws("|", "tenant_id", "request_model", "body"), 256)
    keyed = log.select(F.col("event_id").cast("string").alias("event_id"), at.alias("at"), key.alias("key"), F.floor(at / F.lit(ttl * BLOCK_TTLS)).cast("long").alias("block"), "input_tokens")
    times = keyed.select("key", "block", "at").distinct()

    def exits(t: pa.Table) -> pa.Table:
        v = np.sort(t["at"].to_numpy())
        begin = t["block"][0].as_py() * ttl * BLOCK_TTLS
        after, last = np.searchsorted(v, v + ttl, "right"), np.arange(len(v))
        for i in range(len(v) - 1, -1, -1):
            if after[i] < len(v):
                last[i] = last[after[i]]
        first = np.flatnonzero((v <= begin + ttl) | (np.arange(len(v)) == 0) | (np.arange(len(v)) == np.searchsorted(v, begin + ttl, "right")))
        return pa.table({"key": t["key"].take(pa.array(np.zeros(len(first), int))), "block": t["block"].take(pa.array(np.zeros(len(first), int))), "entry": v[first], "last": v[last[first]]})

    heads = kept(times.groupBy("key", "block").applyInArrow(exits, "key string, block long, entry long, last long"))
    order = Window.partitionBy("key").orderBy("block")
    blocks = heads.select("key", "block").distinct().withColumn("next", F.lead("block").over(order)).withColumn("n", F.row_number().over(order))
    ends = heads.join(blocks.where("next IS NOT NULL").select("key", "block", "next"), ["key", "block"])

    def link(a: pa.Table, b: pa.Table) -> pa.Table:
        entries, last = np.sort(b["entry"].to_numpy()), a["last"].to_numpy()
        to = np.searchsorted(entries, last + ttl, "right")
        # Beyond the last entry: the block holds nothing but hits and the one after it starts afresh.
        to = np.where(to < len(entries), entries[np.minimum(to, len(entries) - 1)], -1) if len(entries) else np.full(len(last), -1)
        return pa.table({"key": a["key"], "block": a["block"], "entry": a["entry"], "next": a["next"], "to": to})

    to = ends.groupBy("key", "next").cogroup(heads.select(F.col("key").alias("key"), F.col("block").alias("next"), F.col("entry").alias("entry")).groupBy("key", "next")).applyInArrow(link, "key string, block long, entry long, next long, to long")
    # A block of hits only passes nothing on: what comes after it starts with its own first call.
    first_of = heads.groupBy("key", "block").agg(F.min("entry").alias("entry"))
    rest = blocks.where("next IS NOT NULL").select("key", "block", "next").join(first_of.select("key", F.col("block").alias("next"), F.col("entry").alias("to")), ["key", "next"]).select("key", "block", F.lit(-1).cast("long").alias("entry"), "next", "to")
    jump = kept(to.unionByName(rest))
    reached = kept(first_of.join(blocks.where("n = 1").select("key", "block"), ["key", "block"]).select("key", "block", "entry"))
    most, done = blocks.agg(F.max("n")).first()[0] or 0, 1
    while done < most:
        on = reached.join(jump, ["key", "block", "entry"]).select("key", F.col("next").alias("block"), F.col("to").alias("entry"))
        reached = kept(reached.unionByName(on))
        then = jump.select("key", F.col("block").alias("next"), F.col("entry").alias("to"), F.col("next").alias("_next"), F.col("to").alias("_to"))
        jump = kept(jump.join(then, ["key", "next", "to"]).select("key", "block", "entry", F.col("_next").alias("next"), F.col("_to").alias("to")))
        done *= 2

    def mark(a: pa.Table, b: pa.Table) -> pa.Table:
        t = a.sort_by([("at", "ascending"), ("event_id", "ascending")])
        v, entry = t["at"].to_numpy(), b["entry"].to_numpy()
        stored = np.zeros(len(v), bool)
        if len(v) and len(entry) and entry[0] >= 0:
            different, where = np.unique(v, return_index=True)
            stored[where[_anchors(different, np.searchsorted(different, entry[0]), ttl)]] = True
        return pa.table({"event_id": t["event_id"], "hit": pa.array(~stored), "input_tokens": t["input_tokens"]})

    rows = keyed.groupBy("key", "block").cogroup(reached.select(*[F.col(c).alias(c) for c in ("key", "block", "entry")]).groupBy("key", "block"))
    out = rows.applyInArrow(mark, "event_id string, hit boolean, input_tokens long")
    return out.select("event_id", "hit", F.when(F.col("hit"), F.col("input_tokens")).otherwise(0).alias("saved_input_tokens"))
