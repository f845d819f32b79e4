"""Streams: ingest with idempotent batches, de-duplication, live rollups and sessions, online vocabulary, signal feed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import pair_key
from ..operators import tables
from ..operators.matching import SERVE, WARM
from ..operators.reports import book
from ..schema import DERIVED, upgrade
from .commits import BatchLog, columns
from .vectors import MATCH, MEMORY, match_arrivals, merge_memory, remembered, state_in_rocksdb


def file_stream(spark: SparkSession, folder: str, name: str, schema: T.StructType) -> DataFrame:
    """A stream over the Parquet table ``name`` in a folder: a single file, or a folder of part files."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
    if path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).getFileStatus(path).isDirectory():
        return spark.readStream.schema(schema).parquet(f"{folder}/{name}")
    return spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(folder)


def json_stream(spark: SparkSession, folder: str, schema: T.StructType) -> DataFrame:
    """Landing files of JSON records; what doesn't parse ends up in ``_corrupt_record`` instead of failing."""
    return spark.readStream.schema(T.StructType([*schema.fields, T.StructField("_corrupt_record", T.StringType())])).option("mode", "PERMISSIVE").json(folder)


def once_each(stream: DataFrame, delay: str = "1 hour") -> DataFrame:
    """At-least-once deliveries, each event once."""
    return stream.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["event_id"])


def live_rollup(stream: DataFrame, window: str = "1 day", delay: str = "1 hour") -> DataFrame:
    g = stream.withWatermark("ts", delay).groupBy(F.window("ts", window).alias("w"), "event_type")
    return g.agg(F.count("*").alias("calls"), F.round(F.sum("value"), 4).alias("cost"), F.count_if(F.col("event_type") == "error").alias("retries")).select(F.col("w.start").alias("day"), "event_type", "calls", "cost", "retries")


def burn_sessions(stream: DataFrame, gap: str = "6 hours", delay: str = "1 hour") -> DataFrame:
    g = stream.withWatermark("ts", delay).groupBy(F.session_window("ts", gap).alias("w"), "user_id")
    return g.agg(F.count("*").alias("calls"), F.round(F.sum("value"), 4).alias("cost")).select(F.col("w.start").alias("first_ts"), "user_id", "calls", "cost")


def drained(stream: DataFrame, folder: str, mode: str = "append") -> DataFrame:
    """All that the stream has now, as a table of Parquet files under ``folder``, which all executors share.

    Executors write and read it. In complete mode every batch is the whole result and overwrites the one before.
    """
    spark, out = stream.sparkSession, f"{folder}/out"
    w = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True)
    if mode == "append":
        w = w.format("parquet").option("path", out)
    else:
        spark.createDataFrame([], stream.schema).write.parquet(out)  # for a stream that never has a batch
        w = w.foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(out))
    w.start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


_ROW, _ID = T.StructType([*DERIVED.fields]), T.StructType([T.StructField("event_id", T.StringType())])
MATCHES = columns(MATCH)
BOOKED = columns("dedup_key string, tenant_id string, objective_id string, work_type string, actor_a string, actor_b string, ts timestamp, mode string, cluster_label string")
#: The tables that ingest writes, and their columns.
TABLES = {"derived": _ROW, "rejected": _ID, "matches": MATCHES, "ledger": BOOKED}


def bookings(matches: DataFrame, rows: DataFrame, objectives: DataFrame | None = None) -> DataFrame:
    """What a batch's matches book: the arriving call's tenant, objective and work type, known objectives only."""
    of = rows.select("event_id", "tenant_id", "objective_id", F.coalesce("work_type", F.lit("unknown")).alias("work_type"))
    out = matches.join(of, "event_id")
    out = out if objectives is None else tables.known_objectives(out, objectives)
    key = F.concat_ws("|", pair_key(F.col("a"), F.col("b")), "objective_id", "work_type")
    return out.select(key.alias("dedup_key"), F.coalesce("tenant_id", F.lit("default")).alias("tenant_id"), "objective_id", "work_type", F.col("a").alias("actor_a"), F.col("b").alias("actor_b"), "ts", "mode", F.col("topic").alias("cluster_label"))


def signals_of(rows: DataFrame, tenants: DataFrame | None = None, objectives: DataFrame | None = None) -> DataFrame:
    """Topic signals of hardened rows: those with a vector, an objective and an actor, behind their tenant's walls.

    Only an objective that the registry knows counts as one; another's label needs the stricter bar.
    """
    out = rows.where("embedding IS NOT NULL AND objective_id IS NOT NULL AND actor_pseudonym IS NOT NULL")
    out = out.withColumn("org", F.coalesce("tenant_id", F.lit("default")))
    if tenants is not None:
        out = tables.with_org(out, tenants)
    known, client = F.col("objective_id"), F.lit(None).cast("string")
    if objectives is not None:
        out = out.join(objectives.select(F.col("objective_id").alias("_objective"), F.col("client").alias("_client")), F.col("objective_id") == F.col("_objective"), "left")
        known, client = F.col("_objective"), F.col("_client")
    return out.select(F.col("actor_pseudonym").alias("actor"), "event_id", "ts", "embedding", "org", "residency", client.alias("client"), known.alias("objective_id"), F.coalesce("objective_label", F.lit("general")).alias("label"), tables.solved(F.col("is_retry_loop"), F.col("output_tokens")).alias("is_solved"))


def ingest(stream: DataFrame, principals: DataFrame, prices: DataFrame, folder: str, checkpoint: str, tenants: DataFrame | None = None, objectives: DataFrame | None = None, **bars):
    """Collector ingest: known columns only, identity bound, counts clamped, priced anew, matched and booked.

    ``derived`` (latest of each event), ``rejected`` (unknown actors and malformed records), ``matches`` and ``ledger``
    of a batch are committed together, see ``BatchLog``. Matching keeps its people in the state store; a batch that runs
    again starts from the state before it. Equal times of one event: the row with the greatest tokens and cost wins, so
    that a replay gives the same.
    """
    log, spark = BatchLog(folder), stream.sparkSession
    good = tables.harden(tables.redact_slugs(tables.bind_identity(upgrade(stream.where("_corrupt_record IS NULL")), principals)[0]), prices)
    found = match_arrivals(signals_of(upgrade(good), tenants, objectives), **bars)
    # One stream of rows as they came and of matches, so that both belong to the same batch.
    came = stream.select(F.struct(*stream.columns).alias("came"), F.lit(None).cast(MATCHES).alias("match"))
    both = came.unionByName(found.select(F.struct(*MATCHES.names).alias("match")), allowMissingColumns=True)

    def each(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        rows, matches = batch.where("came IS NOT NULL").select("came.*"), batch.where("match IS NOT NULL").select("match.*")
        bad = rows.where("_corrupt_record IS NOT NULL").select(F.col("_corrupt_record").alias("event_id"))
        good, unknown = tables.bind_identity(upgrade(rows.where("_corrupt_record IS NULL")), principals)
        latest = tables.upsert(upgrade(tables.harden(tables.redact_slugs(good), prices)), ["event_id"], ORDER)
        log.write(batch_id, {"derived": latest.select(*_ROW.names), "rejected": unknown.select("event_id").union(bad), "matches": matches, "ledger": bookings(matches, latest, objectives)})
        batch.unpersist()

    with state_in_rocksdb(spark):
        return both.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


#: What decides between rows of one event, the last first to tell equal times apart.
ORDER = ["ts", "input_tokens", "output_tokens", "cost_usd", "actor_pseudonym"]


def committed(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table of ``ingest``: all rows of committed batches."""
    return BatchLog(folder).read(spark, name, TABLES[name])


def latest_view(spark: SparkSession, folder: str) -> DataFrame:
    """Last write wins over all committed batches of an ingest's rows."""
    return tables.upsert(committed(spark, folder, "derived"), ["event_id"], ["ts", "batch"]).drop("batch")


def ledger_view(spark: SparkSession, folder: str) -> DataFrame:
    """What is booked: each key once over all committed batches."""
    return book(committed(spark, folder, "ledger").drop("batch"))


def match_stream(stream: DataFrame, folder: str, checkpoint: str, mutual: DataFrame | None = None, **bars):
    """New matches of arriving signals as Parquet files in ``folder``, each pair once, those in ``mutual`` left out."""
    out = match_arrivals(stream, mutual=mutual, **bars)
    with state_in_rocksdb(stream.sparkSession):
        return out.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def memory_stream(stream: DataFrame, folder: str, checkpoint: str, serve: float = SERVE, warm: float = WARM, **how):
    """What team memory offers each arriving row, one row each, in the batch log's table ``memory``."""
    log = BatchLog(folder)
    found = remembered(stream, **how)
    with state_in_rocksdb(stream.sparkSession):
        w = found.writeStream.foreachBatch(lambda batch, i: log.write(i, {"memory": merge_memory(batch, serve, warm)}))
        return w.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def memory_view(spark: SparkSession, folder: str) -> DataFrame:
    return BatchLog(folder).read(spark, "memory", columns(MEMORY)).drop("batch")


def signal_feed(calls: DataFrame, prices: DataFrame) -> DataFrame:
    """Waste lines with the dollars at stake, stream or table."""
    from ..operators.pricing import price_calls
    from ..operators.waste import resend_signal

    return resend_signal(price_calls(calls, prices)).where("signal IS NOT NULL").select("event_id", "ts", "signal", "cache_saving_usd")
