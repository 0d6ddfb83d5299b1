"""Connected components of an edge table, with the smallest id as the name of each."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import written


def connected(edges: DataFrame) -> DataFrame:
    """(id, component) for every id in ``edges`` (a, b).

    Alternating stars: first every neighbour larger than a node, then every one not larger, is hung on the smallest
    node around. Both steps keep the components and shorten paths; once they change nothing all edges are stars.
    Each round is written, so rounds do not grow the plan. An id with many edges is combined before the shuffle.
    """
    edges = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    while True:
        before = _mark(edges)
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), F.least("a", "m").alias("m"))
        # large star: larger neighbours go to the smallest of the neighbourhood
        large = both.join(least, F.col("a") == F.col("n")).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # small star: smaller neighbours and the node itself go to the smallest
        least = large.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "n")
        small = large.join(least, F.col("a") == F.col("n")).select(F.explode(F.array(
            F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct(F.col("a"), F.col("m").alias("b"))
        )).alias("e")).select("e.a", "e.b").where("a <> b").distinct()
        edges = written(small, "edges")
        if _mark(edges) == before:
            break
    return edges.select(F.col("a").alias("id"), F.col("b").alias("component")).union(
        edges.select(F.col("b").alias("id"), F.col("b").alias("component"))
    ).distinct()


def _mark(edges: DataFrame) -> tuple:
    """Number of edges and a checksum of them: one row for the driver."""
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
