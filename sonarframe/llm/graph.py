"""Connected components of an edge table, without the driver seeing links or members."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sonarframe.llm.shared import drop, table


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b longs): the component is its smallest node.

    Alternating large-star and small-star steps (Kiveris et al., 2014): each step
    is an aggregation and a join, and ends in a work table, until the edges are
    stars around the smallest nodes.  The number of steps grows with the logarithm
    of the nodes.
    """
    at = table(_ordered(edges), "edges")
    size = _mark(at)
    while size[0]:
        both = at.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(at.select(F.col("b").alias("u"), F.col("a").alias("v")))
        # least neighbours are tables, so that both sides of each join are exchanges of its own and a hub's rows can be split
        least = table(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m")), "least")
        large = table(_ordered(both.where("v > u").join(least, F.col("u") == F.col("w")).select(F.col("v").alias("a"), F.col("m").alias("b"))), "large")
        drop(least)
        least = table(large.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "w"), "least")
        inner = large.join(least, F.col("a") == F.col("w")).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        after = table(_ordered(inner.unionByName(least.select(F.col("w").alias("a"), F.col("m").alias("b")))), "edges")
        drop(least)
        drop(large)
        drop(at)
        at, before, size = after, size, _mark(after)
        if size == before:
            break
    stars = at.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return stars.unionByName(at.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def _ordered(edges: DataFrame) -> DataFrame:
    return edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())
