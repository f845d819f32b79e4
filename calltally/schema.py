"""The one analytic row: a flat, content-free record of a model call."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_S, _L, _D, _B = T.StringType(), T.LongType(), T.DoubleType(), T.BooleanType()
_COUNTS = T.MapType(T.StringType(), T.LongType())

#: Column names and types of the derived record (fixed values).
DERIVED = T.StructType(
    [
        T.StructField("event_id", _S),
        T.StructField("ts", T.TimestampType()),
        T.StructField("tier", _S),
        T.StructField("provider", _S),
        T.StructField("actor_pseudonym", _S),
        T.StructField("request_model", _S),
        T.StructField("input_tokens", _L),
        T.StructField("output_tokens", _L),
        T.StructField("duplicate_history_tokens", _L),
        T.StructField("cache_read_tokens", _L),
        T.StructField("cache_creation_tokens", _L),
        T.StructField("tokens_estimated", _B),
        T.StructField("cost_usd", _D),
        T.StructField("cost_priced", _B),
        T.StructField("tool", _S),
        T.StructField("app_category", _S),
        T.StructField("repo", _S),
        T.StructField("host_os", _S),
        T.StructField("embedding", T.ArrayType(_D)),
        T.StructField("quality_score", _D),
        T.StructField("acceptance", _D),
        T.StructField("is_retry_loop", _B),
        T.StructField("retry_similarity", _D),
        T.StructField("objective_id", _S),
        T.StructField("objective_label", _S),
        T.StructField("is_orphan", _B),
        T.StructField("attribution_method", _S),
        T.StructField("attribution_confidence", _D),
        T.StructField("ticket_id", _S),
        T.StructField("work_type", _S),
        T.StructField("work_type_source", _S),
        T.StructField("residency", _S),
        T.StructField("tenant_id", _S),
        T.StructField("saved_input_tokens", _L),
        T.StructField("compression", T.ArrayType(_S)),
        T.StructField("compression_detail", _COUNTS),
        T.StructField("shadow_savings", _COUNTS),
        T.StructField("served_from_cache", _B),
        T.StructField("language", _S),
        T.StructField("original_model", _S),
        T.StructField("route_target", _S),
        T.StructField("route_saved_usd", _D),
        T.StructField("route_shadow_usd", _D),
        T.StructField("tm_tier", _S),
        T.StructField("tm_similarity", _D),
        T.StructField("tm_same_language", _B),
        T.StructField("tm_solver", _S),
        T.StructField("tm_shadow_usd", _D),
    ]
)


def upgrade(rows: DataFrame, schema: T.StructType = DERIVED) -> DataFrame:
    """``rows`` with exactly the schema's columns: missing ones null, unknown ones dropped, types cast."""
    have = set(rows.columns)
    return rows.select(*[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields])


def backfill_tenant(rows: DataFrame, tenant: str) -> DataFrame:
    """Rows without a tenant go to the named one; nothing changes for ``default``, which they belong to anyway."""
    return rows if tenant == "default" else rows.withColumn("tenant_id", F.coalesce("tenant_id", F.lit(tenant)))
