"""What a call was for: objective by ticket, repository or vector; work type by branch, prompt or outside label."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import branch_head, cosine, norm, ticket_of
from ..functions.text import with_learned_terms, work_type_of_prompt


def by_joins(calls: DataFrame, objectives: DataFrame, prefixes: DataFrame, repos: DataFrame) -> DataFrame:
    """Ticket prefix, then repository; ``objective_id`` is null where neither is known. Spark broadcasts the
    dims where their size, which it knows, is small."""
    known = objectives.select("objective_id")
    p = prefixes.join(known, "objective_id").select("prefix", F.col("objective_id").alias("_by_ticket"))
    r = repos.join(known, "objective_id").select("repo_key", F.col("objective_id").alias("_by_repo"))
    out = calls.withColumn("ticket_id", F.coalesce("ticket_id", ticket_of(F.col("git_branch"))) if "ticket_id" in calls.columns else ticket_of(F.col("git_branch")))
    out = out.withColumn("_prefix", F.upper(F.substring_index("ticket_id", "-", 1))).join(p, F.col("_prefix") == F.col("prefix"), "left")
    out = out.withColumn("_repo", F.lower("repo")).join(r, F.col("_repo") == F.col("repo_key"), "left")
    method = F.when(F.col("_by_ticket").isNotNull(), "ticket_join").when(F.col("_by_repo").isNotNull(), "repo_join").otherwise("none")
    out = out.withColumns({"objective_id": F.coalesce("_by_ticket", "_by_repo"), "attribution_method": method})
    return out.drop("_prefix", "prefix", "_by_ticket", "_repo", "repo_key", "_by_repo")


def nearest_objective(rows: DataFrame, objectives: DataFrame, threshold: float, key: str = "event_id", shares: int = 8) -> DataFrame:
    """(key, objective_id, confidence) of the objective whose vector is nearest, if near enough; the first wins ties.

    Each row meets each objective once: rows are dealt to ``shares``, every share gets all objectives, and the share is
    the join's key, so that Spark may broadcast few objectives and shuffle many.
    """
    valid = rows.where(F.col("embedding").isNotNull() & (norm(F.col("embedding")) > 0)).select(key, "embedding")
    each = objectives.select("objective_id", "ord", F.col("embedding").alias("_o"), F.explode(F.sequence(F.lit(0), F.lit(shares - 1))).alias("_share"))
    pairs = valid.withColumn("_share", F.pmod(F.xxhash64(key), F.lit(shares)).cast("int")).join(each, "_share")
    scored = pairs.select(key, "objective_id", F.negate("ord").alias("ord"), cosine(F.col("embedding"), F.col("_o")).alias("sim"))
    best = scored.groupBy(key).agg(F.max(F.struct("sim", "ord", "objective_id")).alias("b"))
    return best.where(F.col("b.sim") >= threshold).select(key, "b.objective_id", F.round("b.sim", 3).alias("confidence"))


def attribute(calls: DataFrame, objectives: DataFrame, prefixes: DataFrame, repos: DataFrame, threshold: float | None = None) -> DataFrame:
    """The cascade: ticket, repository, vector (only for rows still open), else orphan."""
    out = by_joins(calls, objectives, prefixes, repos)
    confidence: Column = F.when(F.col("objective_id").isNotNull(), 1.0).otherwise(0.0)
    out = out.withColumn("attribution_confidence", confidence)
    if threshold is not None and "embedding" in calls.columns:
        near = nearest_objective(out.where("objective_id IS NULL"), objectives, threshold).select("event_id", F.col("objective_id").alias("_near"), F.col("confidence").alias("_c"))
        out = out.join(near, "event_id", "left").withColumns(
            {
                "attribution_method": F.when(F.col("objective_id").isNull() & F.col("_near").isNotNull(), "semantic").otherwise(F.col("attribution_method")),
                "attribution_confidence": F.coalesce(F.when(F.col("objective_id").isNull(), F.col("_c")), "attribution_confidence"),
                "objective_id": F.coalesce("objective_id", "_near"),
            }
        )
        out = out.drop("_near", "_c")
    labels = objectives.select("objective_id", "objective_label")
    return out.join(labels, "objective_id", "left").withColumn("is_orphan", F.col("objective_id").isNull())


def work_type_of_branch(calls: DataFrame, heads: DataFrame) -> DataFrame:
    """``work_type`` and ``work_type_source`` from the branch's first word; unknown where it says nothing."""
    out = calls.withColumn("_head", branch_head(F.col("git_branch"))).join(heads, F.col("_head") == F.col("head"), "left")
    return out.withColumns(
        {"work_type": F.coalesce("head_work_type", F.lit("unknown")), "work_type_source": F.when(F.col("head_work_type").isNotNull(), "branch").otherwise("none")}
    ).drop("_head", "head", "head_work_type")


def text_key(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)


def work_types(calls: DataFrame, heads: DataFrame, labels: DataFrame | None = None, prompt: str = "prompt", learned: DataFrame | None = None, terms: Column | None = None) -> DataFrame:
    """The cascade of ``work_type`` with its source: branch, prompt patterns, outside label of the same text, else unknown.

    ``learned`` (term, label) adds two points to a label for each of its terms among the prompt's ``terms``; events have
    ids of their own then.

    ``labels`` (text_key, label) holds one row a text. Rows that need none get a key of their own, which meets nothing and
    keeps them from piling up on null.
    """
    out = work_type_of_branch(calls, heads)
    said, still = work_type_of_prompt(F.coalesce(F.col(prompt), F.lit(""))), F.col("work_type") == "unknown"
    if learned is None:
        out = out.withColumn("_said", F.when(still, said).otherwise("unknown"))
    else:
        rows = out.where(still).select("event_id", F.coalesce(prompt, F.lit("")).alias(prompt))
        scored = with_learned_terms(rows, learned, "event_id", prompt, terms).select(F.col("event_id").alias("_event"), F.col("work_type").alias("_scored"))
        out = out.join(scored, F.col("event_id") == F.col("_event"), "left").withColumn("_said", F.when(still, F.coalesce("_scored", F.lit("unknown"))).otherwise("unknown")).drop("_event", "_scored")
    found = F.col("_said") != "unknown"
    out = out.withColumns({"work_type": F.when(found, F.col("_said")).otherwise(F.col("work_type")), "work_type_source": F.when(found, "prompt").otherwise(F.col("work_type_source"))}).drop("_said")
    if labels is None:
        return out
    key = F.when(still, text_key(F.col(prompt))).otherwise(F.concat(F.lit("-"), F.col("event_id")))
    out = out.withColumn("_text", key).join(labels.select(F.col("text_key").alias("_text"), F.col("label").alias("_label")), "_text", "left")
    given = F.col("_label").isNotNull() & (F.col("_label") != "unknown")
    return out.withColumns({"work_type": F.when(given, F.col("_label")).otherwise(F.col("work_type")), "work_type_source": F.when(given, "label").otherwise(F.col("work_type_source"))}).drop("_text", "_label")


def label_texts(rows: DataFrame, labeller: Callable[[str], str | None], prompt: str = "prompt") -> DataFrame:
    """(text_key, label) of the rows still unknown, each text once; ``labeller`` runs in Arrow batches."""

    def each(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            yield pd.DataFrame({"text_key": pdf.text_key, "label": [labeller(t) for t in pdf.text]})

    texts = rows.where("work_type = 'unknown'").select(text_key(F.col(prompt)).alias("text_key"), F.coalesce(prompt, F.lit("")).alias("text"))
    return texts.dropDuplicates(["text_key"]).mapInPandas(each, "text_key string, label string")
