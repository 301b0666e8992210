"""Connected components of a graph given as an edge table, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hashwave.llm.common import discard, written
from hashwave.operators.joins import splittable_join


def _down(edges: DataFrame) -> DataFrame:
    """Edges from the greater to the smaller node, once each, without loops and nulls."""
    ends = edges.toDF("a", "b").where("a != b")
    return ends.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _large_star(edges: DataFrame) -> DataFrame:
    """Every greater neighbour of a node moves to the node's smallest neighbour."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    smallest = both.groupBy("a").agg(F.min("b").alias("m"))
    moved = splittable_join(both, smallest, ["a"]).where("b > a")
    return moved.select(F.col("b").alias("a"), F.least("a", "m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node, and the node, move to the smallest of them."""
    smallest = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = splittable_join(edges, smallest, ["a"]).where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(smallest.select("a", F.col("m").alias("b"))).distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """``node`` and ``component`` (its smallest node) for all nodes but the smallest of each component.

    ``edges`` has two columns of one orderable type; direction, repetition, loops and nulls do not
    matter. Each round is written to the shared folder in place of the one before, so no lineage grows, and the number of rounds
    grows with the logarithm of the longest path. Minima are aggregated before the shuffle and the
    joins can be split, so a node with very many edges is no bottleneck.
    """
    now, seen = written(_down(edges), "edges"), None
    while True:
        row = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if (row.n, row.h) == seen or row.n == 0:
            return now.select(F.col("a").alias("node"), F.col("b").alias("component"))
        seen, before = (row.n, row.h), now
        now = written(_small_star(_large_star(now).distinct()), "edges")
        discard(before)
