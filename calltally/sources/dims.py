"""Dimensions: prices, the knowledge graph, tenants, principals, tool capabilities. All a few hundred rows at most, kept inside the plan."""

from __future__ import annotations

from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

#: USD per million tokens: input, output, cache read, cache write (fixed values).
PRICES = [
    ("claude-opus-4", 5.00, 25.00, 0.50, 6.25),
    ("claude-sonnet-4", 3.00, 15.00, 0.30, 3.75),
    ("claude-haiku-4", 1.00, 5.00, 0.10, 1.25),
    ("claude-3-5-haiku", 0.80, 4.00, 0.08, 1.00),
    ("claude-3-haiku", 0.25, 1.25, 0.03, 0.30),
    ("claude-3-opus", 15.00, 75.00, 1.50, 18.75),
    ("gpt-5.5", 5.00, 30.00, 0.50, 0.0),
    ("gpt-5.4", 2.50, 15.00, 0.25, 0.0),
    ("gpt-5", 2.50, 15.00, 0.25, 0.0),
    ("gpt-4o-mini", 0.15, 0.60, 0.075, 0.0),
    ("gpt-4o", 2.50, 10.00, 1.25, 0.0),
    ("gpt-4.1-mini", 0.40, 1.60, 0.10, 0.0),
    ("gpt-4.1", 2.00, 8.00, 0.50, 0.0),
    ("o4-mini", 1.10, 4.40, 0.275, 0.0),
    ("o3", 2.00, 8.00, 0.50, 0.0),
    ("gemini-3.5-flash", 1.50, 9.00, 0.375, 0.0),
    ("gemini-3.1-pro", 2.00, 12.00, 0.50, 0.0),
    ("gemini-3", 2.00, 12.00, 0.50, 0.0),
    ("gemini-2.5-pro", 1.25, 10.00, 0.31, 0.0),
    ("gemini-2.5-flash", 0.30, 2.50, 0.075, 0.0),
    ("gemini-2.0-flash", 0.10, 0.40, 0.025, 0.0),
]

#: Branch head to work type (fixed values).
BRANCH_HEADS = [
    ("feature", "feature"),
    ("feat", "feature"),
    ("feature-new", "feature"),
    ("new", "feature"),
    ("fix", "fix"),
    ("bug", "fix"),
    ("bugfix", "fix"),
    ("hotfix", "fix"),
    ("patch", "fix"),
    ("refactor", "refactor"),
    ("refac", "refactor"),
    ("cleanup", "refactor"),
    ("tidy", "refactor"),
    ("perf", "perf"),
    ("optimize", "perf"),
    ("chore", "chore"),
    ("build", "chore"),
    ("ci", "chore"),
    ("ops", "chore"),
    ("deps", "chore"),
    ("release", "chore"),
    ("spike", "exploration"),
    ("poc", "exploration"),
    ("prototype", "exploration"),
    ("experiment", "exploration"),
    ("explore", "exploration"),
    ("research", "exploration"),
    ("docs", "docs"),
    ("doc", "docs"),
    ("test", "test"),
    ("tests", "test"),
    ("qa", "test"),
]
NET_NEW = ("feature", "exploration")
MAINTENANCE = ("fix", "refactor", "perf", "chore", "docs", "test")

#: The knowledge graph over the test tables: (id, label, client, embedding label, monthly budget).
OBJECTIVES = [(f"obj{i}", f"Objective {i}", f"client{i % 3}", i, [40.0, None, 25.0, 300.0, None, 60.0, None, 10.0][i]) for i in range(8)]
PREFIXES = [(f"B{n}", f"obj{n % 8}") for n in range(1, 21)]
REPOS = [("Brand#21", "obj5"), ("brand#22", "obj6")]
SEMANTIC_THRESHOLD = 0.55


def local_table(spark: SparkSession, rows: Iterable[tuple], schema: str | T.StructType) -> DataFrame:
    """A small table inside the plan (a local relation): Spark knows its size, and reading it starts no job and no Python worker."""
    fields = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    columns = list(zip(*rows, strict=True)) or [()] * len(fields)
    arrays = [pa.array(list(c), to_arrow_type(f.dataType)) for c, f in zip(columns, fields, strict=True)]
    return spark.createDataFrame(pa.table(arrays, names=fields.names), fields)


def prices(spark: SparkSession, rows: Iterable[tuple] = PRICES) -> DataFrame:
    return local_table(spark, rows, "price_key string, p_input double, p_output double, p_cache_read double, p_cache_write double")


def branch_heads(spark: SparkSession) -> DataFrame:
    return local_table(spark, BRANCH_HEADS, "head string, head_work_type string")


def objectives(spark: SparkSession, rows: Iterable[tuple] = OBJECTIVES) -> DataFrame:
    return local_table(spark, rows, "objective_id string, objective_label string, client string, ord int, monthly_budget_usd double")


def prefixes(spark: SparkSession, rows: Iterable[tuple] = PREFIXES) -> DataFrame:
    return local_table(spark, [(p.upper(), o) for p, o in rows], "prefix string, objective_id string")


def repos(spark: SparkSession, rows: Iterable[tuple] = REPOS) -> DataFrame:
    return local_table(spark, [(r.lower(), o) for r, o in rows], "repo_key string, objective_id string")


def principals(spark: SparkSession, rows: Iterable[dict]) -> DataFrame:
    """Registered people from a parsed principals file: pseudonym, display name, role, tenant and organisation; never tokens.

    The role defaults to developer, the tenant to ``default``, the organisation to the tenant. Entries without a subject
    are passed over; of entries with one subject the last counts.
    """
    of = {str(r["subject"]): r for r in rows if r.get("subject")}
    listed = [(k, r.get("display_name") or k, r.get("role") or "developer", r.get("tenant_id") or "default", r.get("org") or r.get("tenant_id") or "default") for k, r in of.items()]
    return with_pseudonyms(local_table(spark, listed, "subject string, display_name string, role string, tenant_id string, org string"))


def with_pseudonyms(people: DataFrame) -> DataFrame:
    """``subject`` replaced by its pseudonym."""
    from ..functions.privacy import pseudonym

    return people.select(pseudonym(F.col("subject")).alias("pseudonym"), *[c for c in people.columns if c != "subject"])


def knowledge_graph(spark: SparkSession, graph: dict) -> dict:
    """Dims from a parsed graph file: objectives, repos, ticket prefixes (case-folded), threshold (kept in (0, 1])."""
    listed = [(str(o["id"]), o.get("label", str(o["id"])), o.get("client"), i, o.get("monthly_budget_usd")) for i, o in enumerate(graph.get("objectives") or [])]
    threshold = graph.get("semantic_threshold", SEMANTIC_THRESHOLD)
    try:
        threshold = float(threshold)
    except (TypeError, ValueError):
        threshold = SEMANTIC_THRESHOLD
    return {
        "objectives": objectives(spark, listed),
        "repos": repos(spark, (graph.get("repos") or {}).items()),
        "prefixes": prefixes(spark, (graph.get("ticket_prefixes") or {}).items()),
        "threshold": threshold if 0 < threshold <= 1 else SEMANTIC_THRESHOLD,
    }


def tenants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tenant registry over the test tables: nations below number 20 are registered, their region is org and residency."""
    n, r = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("nation", "region"))
    return n.join(F.broadcast(r), n.n_regionkey == r.r_regionkey).where("n_nationkey < 20").select(
        F.col("n_name").alias("tenant_id"), F.col("r_name").alias("org"), F.col("r_name").alias("tenant_residency")
    )
