"""Sharding by rendezvous hashing over weighted shards (DataFrame functions only).

Every record key scores every shard; the best score wins. A score depends on the key and that shard alone, so a new
shard takes rows only into itself and a removed one gives up only its own. Law: ``key``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import checkpointed, packed, partitions, table

N_SHARDS = 24
ROW_BYTES = 8


def shard_of(key: Column, weights: list[float]) -> Column:
    """Shard number by weighted rendezvous: the largest -weight / ln(u), u in (0, 1) drawn from (key, shard).

    A shard's share of the keys is its weight's share. A null key is one key like any other. Ties, which need equal
    53-bit draws, go to the larger shard number.
    """
    scores = []
    for shard, weight in enumerate(weights):
        bits = F.shiftrightunsigned(F.xxhash64(F.coalesce(key.cast("string"), F.lit("\0null")), F.lit(shard)), 11)
        u = (bits.cast("double") + 0.5) / float(2**53)
        scores.append(F.struct((F.lit(-float(weight)) / F.log(u)).alias("score"), F.lit(shard).alias("shard")))
    return F.greatest(*scores)["shard"] if len(scores) > 1 else F.lit(0)


def assign_shards(docs: DataFrame, n_shards: int = N_SHARDS, weights: list[float] | None = None, id_col: str = "doc_id", text_col: str = "text", row_bytes: int = ROW_BYTES) -> DataFrame:
    """One row per document: its id, size (UTF-8 bytes + ``row_bytes``), CRC-32, law, shard, slot and shard after growth.

    ``slot`` counts a shard's rows from 0 without gaps. It is numbered in two levels, so that no shard meets in one
    task: within (shard, bucket of the row's hash), then offset by the counts of the shard's earlier buckets; those
    counts are ``n_shards`` times the buckets, a few per shuffle partition, and are summed up in a small window per
    shard. A null text has no bytes; rows equal in id and text get neighbouring slots; equal ids share a shard.
    """
    weights = weights or [1.0] * n_shards
    key, text = F.col("row")[id_col], F.col("row")[text_col]
    rows = packed(docs.select(id_col, text_col)).select(
        key.alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + row_bytes).cast("long").alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).cast("long").alias("text_crc32"),
        F.lit("key").alias("law"),
        shard_of(key, weights).cast("int").alias("shard"),
        shard_of(key, [*weights, sum(weights) / len(weights)]).cast("int").alias("grown_shard"),
    )
    rows = rows.withColumn("_b", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(2 * partitions(docs.sparkSession))).cast("int"))
    rows = checkpointed(rows)  # read twice: small fixed-width rows instead of the texts
    counts = rows.groupBy("shard", "_b").count()
    before = counts.select("shard", "_b", (F.sum("count").over(Window.partitionBy("shard").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1))).alias("_n"))
    in_bucket = F.row_number().over(Window.partitionBy("shard", "_b").orderBy("doc_id", "text_crc32", "size"))
    numbered = rows.withColumn("_r", in_bucket).join(before, ["shard", "_b"], "left")
    return numbered.select("doc_id", "size", "text_crc32", "law", "shard", (F.coalesce("_n", F.lit(0)) + F.col("_r") - 1).cast("long").alias("slot"), "grown_shard")


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign_shards(table(spark, sf_dir, "documents"))
