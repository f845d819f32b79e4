"""Pieces shared by the training-data operators: table access, keys, checkpoints, Arrow helpers."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space of every contract here: space and \t \n \v \f \r.
WS_CLASS = r"[\x20\x09-\x0D]"
WORD_CLASS = r"[^\x20\x09-\x0D]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    """Shuffle partitions of the session: the one size hint that grows with the input."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` with its lineage cut, kept in the shared folder of spark.checkpoint.dir.

    Where that is unset, a session of one machine (master ``local``) takes a temporary folder; any other has to name one.
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not re.fullmatch(r"local(\[[^]]*\])?", sc.master):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            import tempfile

            folder = tempfile.mkdtemp(prefix="calltally-checkpoint-")
        sc.setCheckpointDir(folder)
    return df.checkpoint()


def spread(spark: SparkSession, count: int) -> list[int]:
    """``count`` different numbers (a multiple of ``partitions``) that hash partitioning deals out evenly, in turn.

    Groups numbered 0, 1, 2 ... meet in some partitions and leave others empty; these don't.
    """
    n = partitions(spark)
    each = count // n
    ids = spark.range(24 * count + 200 * n).select(F.col("id").cast("int").alias("i"))
    of = ids.groupBy(F.pmod(F.hash("i"), F.lit(n)).alias("p")).agg(F.slice(F.sort_array(F.collect_list("i")), 1, each).alias("l"))
    lists = {r["p"]: r["l"] for r in of.collect()}
    return [lists[p][k] for k in range(each) for p in range(n)]


def packed(docs: DataFrame) -> DataFrame:
    """All columns in one struct ``row``, so that no column of the caller clashes with ours."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))


def unpacked(df: DataFrame, columns: list[str], replaced: dict[str, Column] | None = None) -> DataFrame:
    """The caller's columns again, some of them replaced."""
    replaced = replaced or {}
    return df.select(*[(replaced[c] if c in replaced else F.col("row").getField(c)).alias(c) for c in columns])


def row_keys(id_col: Column, text: Column) -> list[Column]:
    """96 bits that tell rows apart by id and text; rows equal in both share a key (and every result)."""
    return [F.xxhash64(id_col, text).alias("_k"), F.hash(text, id_col).alias("_k2")]


def texts_of(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text; null is empty."""
    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string or binary column, and where each text starts in them (one more than texts)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = column.cast(pa.large_binary())
    offsets = np.frombuffer(wide.buffers()[1], np.int64, len(wide) + 1, wide.offset * 8) if len(wide) else np.zeros(1, np.int64)
    raw = wide.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def batches(rows: list[dict], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    if rows:
        yield pa.RecordBatch.from_pylist(rows, schema)
