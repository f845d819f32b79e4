"""How well a classifier does on labelled rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import is_net_new, ratio


def confusion(rows: DataFrame, expected: Column, predicted: Column) -> DataFrame:
    """``expected``, ``predicted``, ``n``: how often each label was taken for each. Rows without an expected label don't count."""
    out = rows.select(expected.alias("expected"), F.coalesce(predicted, F.lit("unknown")).alias("predicted")).where("expected IS NOT NULL")
    return out.groupBy("expected", "predicted").agg(F.count("*").alias("n"))


def accuracy(matrix: DataFrame) -> DataFrame:
    """From a confusion matrix: ``label``, ``n``, ``correct``, ``accuracy``, ``precision`` of each expected label; then of all, and of the split in new work and the rest.

    Precision is over what was taken for the label; for all and the split it equals the accuracy.
    """
    hit = F.when(F.col("expected") == F.col("predicted"), F.col("n")).otherwise(0)
    taken = matrix.groupBy(F.col("predicted").alias("label")).agg(F.sum("n").alias("taken"))
    per = matrix.groupBy(F.col("expected").alias("label")).agg(F.sum("n").alias("n"), F.sum(hit).alias("correct")).join(taken, "label", "left")
    split = F.when(is_net_new(F.col("expected")) == is_net_new(F.col("predicted")), F.col("n")).otherwise(0)
    whole = matrix.agg(F.sum("n").alias("n"), F.sum(hit).alias("a"), F.sum(split).alias("b")).where("n IS NOT NULL")
    both = whole.select(F.explode(F.array(F.struct(F.lit("(all)").alias("label"), F.col("a").alias("correct")), F.struct(F.lit("(net new or not)").alias("label"), F.col("b").alias("correct")))).alias("x"), "n").select("x.label", "n", "x.correct", F.col("n").alias("taken"))
    return per.unionByName(both).select("label", "n", "correct", ratio(F.col("correct"), F.col("n")).alias("accuracy"), ratio(F.col("correct"), F.col("taken")).alias("precision"))
