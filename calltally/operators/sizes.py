"""Broadcast hints that are held against a size first, and tables that are kept between rounds."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a dimension up to which it is sent to all executors.
MAX_BROADCAST_ROWS = 100_000


def small(dim: DataFrame, most: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """``dim`` with a broadcast hint if it has no more than ``most`` rows, else as it is, so that Spark shuffles the join.

    Counting stops after ``most + 1`` rows. Take it for tables and local dims, not for long plans, which would run twice.
    """
    return F.broadcast(dim) if dim.limit(most + 1).count() <= most else dim


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; only a session of one machine may do without."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return tempfile.mkdtemp(prefix="calltally-")


def kept(df: DataFrame) -> DataFrame:
    """``df`` with its lineage cut in the shared folder, for what is read again and again."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()
