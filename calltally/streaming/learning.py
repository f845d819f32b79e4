"""A vocabulary that learns while rows arrive, and classifies those that come after."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions import text as X
from .commits import BatchLog, columns
from .vectors import state_in_rocksdb

CHANGE = "term string, label string, support long, total long"
SUPPORT, SHARE = 4, 0.8


HELD = ["term", "label", "n", "stands"]


class _Vocabulary(StatefulProcessor):
    """The terms of one bucket, read and written as one value: how often each was seen with each label, and which it stands for at present."""

    def __init__(self, support: int, share: float, most: int | None):
        self.support, self.share, self.most = support, share, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("held", "term array<string>, label array<string>, n array<long>, stands array<boolean>")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows))[["term", "label", "n"]].assign(stands=False)
        parts = [pd.DataFrame(dict(zip(HELD, map(list, self.held.get()), strict=True))), new] if self.held.exists() else [new]
        held = pd.concat(parts).groupby(["term", "label"], as_index=False).agg({"n": "sum", "stands": "max"})
        of = held.groupby("term")
        held["total"], held["stood"] = of.n.transform("sum"), of.stands.transform("max")
        held = held.sort_values(["term", "n", "label"])
        top = ~held.term.duplicated(keep="last")
        held["stands"] = top & (held.n >= self.support) & (held.n >= self.share * held.total)
        now = held[top]
        said = now[now.term.isin(new.term) & (now.stands | now.stood.astype(bool))]
        if self.most is not None and len(now) > self.most:  # the least seen that stand for nothing
            out = now[~now.stands].sort_values(["total", "term"]).term[: len(now) - self.most]
            held = held[~held.term.isin(out)]
        self.held.update(tuple(held[c].tolist() for c in HELD))
        if len(said):
            yield pd.DataFrame({"term": said.term, "label": said.label.where(said.stands, None), "support": said.n, "total": said.total})

    def close(self) -> None:
        pass


#: Rows of a task that are summed before they are shuffled.
SUMMED = 1_000_000


def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Uses of each (bucket, term, label), summed over stretches of a task's rows."""
    stretch, n = [], 0

    def total() -> Iterator[pa.RecordBatch]:
        sums = pa.Table.from_batches(stretch).group_by(["bucket", "term", "label"]).aggregate([([], "count_all")])
        yield from sums.rename_columns(["bucket", "term", "label", "n"]).select(["bucket", "term", "label", "n"]).to_batches(max_chunksize=100_000)

    for b in batches:
        stretch, n = [*stretch, b], n + b.num_rows
        if n >= SUMMED:
            yield from total()
            stretch, n = [], 0
    if n:
        yield from total()


def standings(stream: DataFrame, terms: Column, label: str, support: int = SUPPORT, share: float = SHARE, buckets: int = 512, most: int | None = None) -> DataFrame:
    """Changes of what terms stand for: ``label`` is null where one has become ambiguous. ``term``, ``support``, ``total``.

    Rows teach their terms by their label; unknown and null labels teach nothing. A term stands for a label once it was
    seen ``support`` times with it and in a ``share`` of all its uses, and no longer if that share is lost. Terms are dealt to
    ``buckets``; a bucket keeps ``most`` terms, if given, and forgets the least seen that stand for nothing.
    """
    taught = stream.where(F.col(label).isNotNull() & (F.col(label) != "unknown")).select(F.explode(terms).alias("term"), F.col(label).alias("label"))
    bucket = F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int").alias("bucket")
    keyed = taught.select(bucket, "term", "label").mapInArrow(summed, "bucket int, term string, label string, n long")
    return keyed.groupBy("bucket").transformWithStateInPandas(_Vocabulary(support, share, most), CHANGE, "Append", "None")


def vocabulary(spark: SparkSession, folder: str) -> DataFrame:
    """What each term stands for now, by the committed batches; ambiguous terms are out."""
    changes = BatchLog(folder).read(spark, "vocabulary", columns(CHANGE))
    now = changes.groupBy("term").agg(F.max_by(F.struct("label", "support", "total"), "batch").alias("m"))
    return now.select("term", "m.label", "m.support", "m.total").where("label IS NOT NULL")


def learning_stream(stream: DataFrame, folder: str, checkpoint: str, terms: Column, label: str, id_col: str = "event_id", text_col: str = "prompt", **how):
    """Each batch is classified with the vocabulary of the batches before it, then teaches its own labels.

    Tables of one commit: ``classified`` (id and work type) and ``vocabulary`` (changes of standing).
    """
    log, spark = BatchLog(folder), stream.sparkSession
    change = columns(CHANGE)
    came = stream.select(F.struct(*stream.columns).alias("came"), F.lit(None).cast(change).alias("change"))
    both = came.unionByName(standings(stream, terms, label, **how).select(F.struct(*change.names).alias("change")), allowMissingColumns=True)

    def each(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        rows = batch.where("came IS NOT NULL").select("came.*")
        before = log.read(spark, "vocabulary", change).where(F.col("batch") < batch_id)
        now = before.groupBy("term").agg(F.max_by("label", "batch").alias("label")).where("label IS NOT NULL")
        # A batch before which nothing was learned isn't taken apart for terms.
        typed = X.with_learned_terms(rows.select(F.col(id_col).cast("string").alias("event_id"), F.coalesce(text_col, F.lit("")).alias(text_col)), None if now.isEmpty() else now, "event_id", text_col, terms)
        log.write(batch_id, {"classified": typed, "vocabulary": batch.where("change IS NOT NULL").select("change.*")})
        batch.unpersist()

    with state_in_rocksdb(spark):
        return both.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def classified(spark: SparkSession, folder: str) -> DataFrame:
    return BatchLog(folder).read(spark, "classified", columns("event_id string, work_type string"))
