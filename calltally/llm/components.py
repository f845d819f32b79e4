"""Connected components of a graph of links, with every node's label the smallest node it can reach."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed


def components(links: DataFrame) -> DataFrame:
    """``node``, ``label`` for every node of ``links`` (columns ``a``, ``b``); rounds of large and small stars.

    A round links each node's larger neighbours, then its smaller ones, to the smallest of them, which keeps
    components as they are and takes logarithmically many rounds; they end when nothing changes any more. Minima are partial sums on the map side, so a node
    with very many links is no burden. Null nodes and self links are ignored; no links, no rows.
    """
    edges = checkpointed(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    while True:
        state = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        state = (state["n"], state["h"])
        if state == before or state[0] == 0:
            break
        before = state
        # Large star: larger neighbours of u go to the smallest of u and its neighbours.
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        edges = both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # Small star: u and its smaller neighbours go to the smallest of them.
        least = edges.groupBy("a").agg(F.min("b").alias("m"))
        stars = edges.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
        edges = checkpointed(stars.where("a <> b").distinct())
    labels = edges.groupBy("a").agg(F.min("b").alias("label")).select(F.col("a").alias("node"), "label")
    roots = labels.select(F.col("label").alias("node"), "label").distinct()
    return checkpointed(labels.union(roots))
