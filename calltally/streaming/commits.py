"""Batches that land in several tables at once: a batch shows in all of its tables or in none."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.sizes import shared_folder  # noqa: F401


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(p)


_TYPES = {"string": T.StringType(), "long": T.LongType(), "double": T.DoubleType(), "boolean": T.BooleanType(), "timestamp": T.TimestampType()}


def columns(spec: str) -> T.StructType:
    """A schema of plain types from ``name type, name type``, without a session."""
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in (x.split() for x in spec.split(", "))])


_MANIFEST = columns("batch long, attempt string")


class BatchLog:
    """Append-only tables under ``folder`` with a manifest of batches.

    Every try to write a batch goes to folders of its own; the manifest then names the try that counts. A batch that is
    killed between two tables isn't named, so no reader sees any of it, whatever its files. One that runs again after it
    was named replaces itself. Readers join the manifest by (batch, try), which prunes the other folders.
    """

    def __init__(self, folder: str):
        self.folder = folder.rstrip("/")

    def write(self, batch_id: int, tables: dict[str, DataFrame]) -> None:
        """``tables`` by name, then the manifest: one small file that Spark renames into place."""
        attempt, spark = f"try-{uuid.uuid4().hex}", None
        for name, rows in tables.items():
            spark = rows.sparkSession
            rows.write.parquet(f"{self.folder}/{name}/batch={batch_id}/attempt={attempt}")
        self._name(spark, batch_id, attempt)

    def _name(self, spark: SparkSession, batch_id: int, attempt: str) -> None:
        spark.createDataFrame([(batch_id, attempt)], _MANIFEST).coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/manifest/n={batch_id}")

    def manifest(self, spark: SparkSession) -> DataFrame:
        if not exists(spark, f"{self.folder}/manifest"):
            return spark.createDataFrame([], _MANIFEST)
        return spark.read.schema(_MANIFEST).option("recursiveFileLookup", True).parquet(f"{self.folder}/manifest")

    def read(self, spark: SparkSession, name: str, schema: T.StructType) -> DataFrame:
        """All committed rows of a table and their ``batch``; none before the first commit."""
        full = T.StructType([*schema.fields, *_MANIFEST.fields])
        if not exists(spark, f"{self.folder}/{name}"):
            return spark.createDataFrame([], full).drop("attempt")
        rows = spark.read.schema(full).parquet(f"{self.folder}/{name}")
        return rows.join(F.broadcast(self.manifest(spark)), ["batch", "attempt"], "left_semi").select(*schema.names, "batch")
