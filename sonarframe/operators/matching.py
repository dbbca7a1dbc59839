"""Nearest, range, containment and overlap joins.

Theta joins go through an equality on the key and on time buckets, so Spark shuffles
or broadcasts by size as for any equi-join, and a row meets only rows of its own
bucket and the ones next to it.  An interval is one row for each bucket it touches, so
``width`` should be about as long as the intervals are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _buckets(low: Column, high: Column, width: float) -> Column:
    return F.explode(F.sequence(F.floor(low / width).cast("long"), F.floor(high / width).cast("long")))


def nearest(left: DataFrame, right: DataFrame, keys: list[str], left_at: str, right_at: str, radius: float, left_id: str, keep_unmatched: bool = True) -> DataFrame:
    """For each row of ``left`` the nearest ``right_at`` of its key within ``radius``; the earlier of equally near ones.

    Rows that share a ``left_id`` are told apart by key and position.
    """
    width, on = max(radius, 1e-9), list(dict.fromkeys([*keys, left_id, left_at]))
    asked = left.select(*on, _buckets(F.col(left_at) - radius, F.col(left_at) + radius, width).alias("__b"))
    given = right.select(*keys, F.col(right_at).alias("__t"), F.floor(F.col(right_at) / width).cast("long").alias("__b"))
    far = F.abs(F.col("__t") - F.col(left_at))
    found = asked.join(given, [*keys, "__b"]).where(far <= radius).groupBy(*on).agg(F.min(F.struct(far.alias("distance"), F.col("__t").alias("matched"))).alias("__m"))
    return left.join(found, on, "left" if keep_unmatched else "inner").withColumn("matched", F.col("__m.matched")).withColumn("distance", F.col("__m.distance")).drop("__m")


def range_argmin(bands: DataFrame, frames: DataFrame, keys: list[str], low: str, high: str, at: str, value: str, band_id: str, fallback: Column, width: float) -> DataFrame:
    """Position of the lowest value in each band low..high (inclusive), the first of equals; the fallback in an empty band."""
    on = list(dict.fromkeys([*keys, band_id, low, high]))
    asked = bands.select(*on, _buckets(F.col(low), F.col(high), width).alias("__b"))
    given = frames.select(*keys, F.col(at).alias("__t"), F.col(value).alias("__v"), F.floor(F.col(at) / width).cast("long").alias("__b"))
    best = asked.join(given, [*keys, "__b"]).where((F.col("__t") >= F.col(low)) & (F.col("__t") <= F.col(high))).groupBy(*on).agg(F.min(F.struct("__v", "__t")).alias("__m"))
    return bands.join(best, on, "left").withColumn("cut", F.coalesce(F.col("__m.__t"), fallback)).drop("__m")


def overlaps(left: DataFrame, right: DataFrame, keys: list[str], width: float, slack: float = 0.0) -> DataFrame:
    """Pairs of intervals (start, end) of a key that overlap; each pair once, in the first bucket that both have."""
    a = left.select(*keys, F.struct(*left.columns).alias("l"), _buckets(F.col("start"), F.col("end"), width).alias("__b"))
    b = right.select(*keys, F.struct(*right.columns).alias("r"), _buckets(F.col("start") - slack, F.col("end") + slack, width).alias("__b"))
    first = F.greatest(F.floor(F.col("l.start") / width), F.floor((F.col("r.start") - slack) / width)).cast("long")
    meet = (F.col("l.start") < F.col("r.end") + slack) & (F.col("l.end") > F.col("r.start") - slack) & (F.col("__b") == first)
    return a.join(b, [*keys, "__b"]).where(meet).drop("__b")


def contained(points: DataFrame, regions: DataFrame, keys: list[str], at: str, width: float) -> DataFrame:
    """Each point with the regions start <= at < end of its key."""
    b = regions.select(*keys, "start", "end", _buckets(F.col("start"), F.col("end"), width).alias("__b"))
    a = points.withColumn("__b", F.floor(F.col(at) / width).cast("long"))
    return a.join(b, [*keys, "__b"]).where((F.col(at) >= F.col("start")) & (F.col(at) < F.col("end"))).drop("__b")


def lookup(rows: DataFrame, cache: DataFrame, keys: list[str], signature: str) -> DataFrame:
    """Earlier analysis of a row, taken only if its signature is the same."""
    return rows.join(cache, [*keys, signature], "left")


def children(nodes: DataFrame, others: DataFrame, keys: list[str], width: float) -> DataFrame:
    """Nodes (start, end) that lie inside each node, by key."""
    a = nodes.select(*keys, F.col("start").alias("p_start"), F.col("end").alias("p_end"), _buckets(F.col("start"), F.col("end"), width).alias("__b"))
    b = others.withColumn("__b", F.floor(F.col("start") / width).cast("long"))
    return a.join(b, [*keys, "__b"]).where((F.col("start") >= F.col("p_start")) & (F.col("end") <= F.col("p_end"))).drop("__b")
