"""Table maintenance and gates on inbound rows: upserts, tenant and identity binding, hardening, exports."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.columns import cost_band, csv_safe, ticket_of
from ..functions.text import redact_patterns
from ..sources.calls import latest
from . import pricing
from .sizes import small

TOKEN_CAP = 100_000_000


def upsert(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Last write wins by key; what an append-only log shows through its latest-wins view."""
    return latest(rows, key, order)


def insert_once(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The first row of each key stays."""
    rest = [c for c in rows.columns if c not in key]
    first = rows.groupBy(*key).agg(F.min(F.struct(*order, *[F.col(c).alias(f"_{c}") for c in rest])).alias("_m"))
    return first.select(*key, *[F.col(f"_m._{c}").alias(c) for c in rest])


def tenant_upsert(writes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted latest rows, rejected writes): a tenant never moves to another organisation than its first."""
    owner = writes.groupBy("tenant_id").agg(F.min_by("org", "seq").alias("_owner"))
    judged = writes.join(owner, "tenant_id")
    good = judged.where("org = _owner").drop("_owner")
    return latest(good, ["tenant_id"], ["seq"]), judged.where("org <> _owner").drop("_owner")


def match_feed(matches: DataFrame) -> DataFrame:
    """Both directions of every match, no self rows, latest by (owner, peer, topic)."""
    one = matches.select(F.col("a").alias("owner"), F.col("b").alias("peer"), "topic", "mode", "ts")
    two = matches.select(F.col("b").alias("owner"), F.col("a").alias("peer"), "topic", "mode", "ts")
    return latest(one.union(two).where("owner <> peer"), ["owner", "peer", "topic"], ["ts", "mode"])


def mutual_consent(consents: DataFrame) -> DataFrame:
    """Consents with ``mutual``: the other side agreed on the same topic too."""
    c = consents.select("owner", "peer", "topic").distinct()
    other = c.select(F.col("peer").alias("owner"), F.col("owner").alias("peer"), "topic", F.lit(True).alias("mutual"))
    return c.join(other, ["owner", "peer", "topic"], "left").fillna({"mutual": False})


def reveal(matches: DataFrame, consents: DataFrame, principals: DataFrame) -> DataFrame:
    """The peer's name on matches that both sides consented to; nulls else."""
    both = mutual_consent(consents).where("mutual").select("owner", "peer", "topic", "mutual")
    out = matches.join(both, ["owner", "peer", "topic"], "left").join(principals.select(F.col("pseudonym").alias("peer"), "display_name"), "peer", "left")
    return out.select("owner", "peer", "topic", F.coalesce("mutual", F.lit(False)).alias("mutual"), F.when(F.col("mutual"), F.col("display_name")).alias("peer_name"))


def bind_identity(rows: DataFrame, principals: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted with the registry's tenant, rejected): rows that name an unknown actor go."""
    p = principals.select(F.col("pseudonym").alias("actor_pseudonym"), F.col("tenant_id").alias("_tenant"))
    good = rows.join(p, "actor_pseudonym").withColumn("tenant_id", F.col("_tenant")).drop("_tenant")
    return good, rows.join(p, "actor_pseudonym", "left_anti")


def with_org(rows: DataFrame, tenants: DataFrame) -> DataFrame:
    """Organisation and residency of the tenant; an unregistered one is its own organisation."""
    t = small(tenants.select("tenant_id", F.col("org").alias("_org"), F.col("tenant_residency")))
    out = rows.join(t, "tenant_id", "left")
    return out.withColumns({"org": F.coalesce("_org", F.concat(F.lit("unreg:"), "tenant_id")), "residency": F.coalesce("tenant_residency", "residency")}).drop("_org", "tenant_residency")


def clamped(c: str) -> Column:
    """A token count as text or number: between 0 and the cap, 0 if it is none."""
    return F.least(F.lit(TOKEN_CAP), F.greatest(F.lit(0), F.coalesce(F.col(c).try_cast("bigint"), F.lit(0)))).cast("long")


def harden(rows: DataFrame, prices: DataFrame) -> DataFrame:
    """Clamp token counts and price anew; the sender's cost is ignored."""
    counts = [c for c in rows.columns if c.endswith("_tokens")]
    out = rows.withColumns({c: clamped(c) for c in counts}).drop("cost_usd", "cost_priced", "cache_saving_usd")
    return pricing.price_calls(out, prices)


def rederive_routing(rows: DataFrame, prices: DataFrame) -> DataFrame:
    """Routing saving from the tokens: realised where the cheap model was the one sent, else shadow."""
    both = pricing.with_both_prices(rows, prices, "original_model")
    saving = F.when(F.col("route_target").isNotNull(), F.greatest(F.lit(0.0), pricing.usd(pricing.cost("a_") - pricing.cost("b_")))).otherwise(0.0)
    sent = F.col("request_model") == F.col("route_target")
    return both.withColumns({"route_saved_usd": F.when(sent, saving).otherwise(0.0), "route_shadow_usd": F.when(sent, 0.0).otherwise(saving)}).drop(*[x + c for x in ("a_", "b_") for c in prices.columns])


def fresh(rows: DataFrame, now: datetime, days: int = 14) -> DataFrame:
    return rows.where(F.col("ts") >= F.lit(now) - F.expr(f"interval {days} days"))


def known_objectives(rows: DataFrame, objectives: DataFrame) -> DataFrame:
    return rows.join(small(objectives.select("objective_id")), "objective_id", "left_semi")


def chargeback(rolled: DataFrame, k: int = 5) -> DataFrame:
    """An exportable rollup: labels below k people dropped, no cell a formula."""
    return rolled.where(F.col("actors") >= k).select(csv_safe(F.col("label")).alias("label"), "calls", "tokens", "cost")


def export(rolled: DataFrame, path: str, kind: str = "csv") -> None:
    writer = chargeback(rolled).write.mode("overwrite")
    writer.option("header", True).csv(path) if kind == "csv" else writer.json(path)


def solved(is_retry_loop: Column, output_tokens: Column) -> Column:
    """Whether a call counts as somebody having got a result: not part of a retry loop, and with an answer."""
    return ~F.coalesce(is_retry_loop, F.lit(False)) & (F.coalesce(output_tokens, F.lit(0)) > 0)


def capsules(rows: DataFrame) -> DataFrame:
    """Latest content-free facts of how someone solved an objective."""
    done = rows.where(solved(F.col("is_retry_loop"), F.col("output_tokens")) & F.col("objective_id").isNotNull())
    return latest(done.select("actor_pseudonym", "objective_id", "request_model", "work_type", "cost_usd", "ts", "event_id"), ["actor_pseudonym", "objective_id"], ["ts", "event_id"])


def with_capsules(matches: DataFrame, capsules: DataFrame) -> DataFrame:
    """Matches with the peer's capsule on their objective; only where one side had solved it."""
    c = capsules.select(F.col("actor_pseudonym").alias("peer"), "objective_id", *capsule_facts(F.struct("request_model", cost_band(F.col("cost_usd")).alias("band"))))
    return shown_capsules(matches.join(c, ["peer", "objective_id"], "left"))


#: What a capsule tells.
CAPSULE = ("capsule_model", "capsule_band")


def capsule_columns() -> list[Column]:
    """What of a call its capsule is made of besides time, id and model, in short values."""
    return [solved(F.col("is_retry_loop"), F.col("output_tokens")).alias("_solved"), cost_band(F.col("cost_usd")).alias("_band")]


def capsule() -> Column:
    """A call's capsule, null unless it solved, from ``capsule_columns``; the greatest of a person's on an objective is the one of ``capsules``."""
    return F.when(F.col("_solved"), F.struct("ts", "event_id", "request_model", F.col("_band").alias("band")))


def capsule_facts(c: Column) -> list[Column]:
    return [c["request_model"].alias("capsule_model"), c["band"].alias("capsule_band")]


def shown_capsules(matches: DataFrame) -> DataFrame:
    """Capsules are told only where one side had solved it."""
    return matches.withColumns({k: F.when(F.col("mode") == "solved_reuse", F.col(k)) for k in CAPSULE})


#: What may hold free text on inbound rows.
SLUGS = ("repo", "objective_label", "ticket_id", "work_type", "tool")


def redact_slugs(rows: DataFrame, columns: tuple[str, ...] = SLUGS) -> DataFrame:
    """Slug columns with secrets and personal data replaced, whatever the sender did."""
    return rows.withColumns({c: redact_patterns(F.col(c)) for c in columns if c in rows.columns})


def with_overrides(rows: DataFrame, given: dict[str, Column], branch: str = "git_branch") -> DataFrame:
    """What a caller states wins over what was detected; a ticket that neither gives is the branch's."""
    out = rows.withColumns({c: F.coalesce(v, F.col(c)) if c in rows.columns else v for c, v in given.items()})
    return out.withColumn("ticket_id", F.coalesce(F.col("ticket_id") if "ticket_id" in out.columns else F.lit(None), ticket_of(F.col(branch))))


def with_capabilities(rows: DataFrame, tools: DataFrame) -> DataFrame:
    """Capture tier and fidelity flags of each row's tool, by name or other name. Columns of ``tools``: name, aliases and the rest."""
    rest = [c for c in tools.columns if c not in ("name", "aliases")]
    names = tools.select(F.explode(F.array_union(F.array("name"), "aliases")).alias("tool"), *rest).dropDuplicates(["tool"])
    return rows.join(names, "tool", "left")


def conversation_keys(turns: DataFrame, chars: int = 200) -> DataFrame:
    """One key a conversation: the hash of its first user turn's first characters."""
    own = turns.where("role = 'user'")
    return own.groupBy("conv_id").agg(F.sha2(F.min_by(F.substring(F.coalesce("text", F.lit("")), 1, chars), "turn").cast("binary"), 256).alias("key"))
