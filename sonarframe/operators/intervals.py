"""Interval algebra on region tables (key, start, end) and region arrays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sonarframe.functions.columns import col

REGIONS = "array<struct<start:double,end:double>>"
HISTORY_LIMIT = 80


def _region(start, end) -> Column:
    return F.struct(start.cast("double").alias("start"), end.cast("double").alias("end"))


def islands(rows: DataFrame, keys: list[str], at: str, inside: Column, hop: float, bridge: float = 0.0) -> DataFrame:
    """Regions of frames that are ``inside``; outside runs shorter than ``bridge`` are bridged.

    A region ends where the next outside frame begins, the last one a hop after the last frame.
    """
    w = Window.partitionBy(*keys).orderBy(at)
    rows = rows.withColumn("__in", inside)
    run = F.sum(F.when(F.coalesce(F.col("__in") != F.lag("__in").over(w), F.lit(True)), 1).otherwise(0)).over(w)
    runs = rows.withColumn("__run", run).groupBy(*keys, "__run", "__in").agg(F.min(at).alias("__from"), F.max(at).alias("__to"), F.count("*").alias("__n"))
    runs = runs.withColumn("__in", F.col("__in") | (F.col("__n") * hop < bridge))
    v = Window.partitionBy(*keys).orderBy("__run")
    runs = runs.withColumn("__end", F.coalesce(F.lead("__from").over(v), F.col("__to") + hop))
    runs = runs.withColumn("__island", F.sum(F.when(F.coalesce(F.col("__in") != F.lag("__in").over(v), F.lit(True)), 1).otherwise(0)).over(v))
    return runs.where("__in").groupBy(*keys, "__island").agg(F.min("__from").alias("start"), F.max("__end").alias("end")).drop("__island")


def merge(regions: DataFrame, keys: list[str], gap: float) -> DataFrame:
    """Neighbours with a gap of ``gap`` or less become one region that ends where the later one does (not the longer one)."""
    w = Window.partitionBy(*keys).orderBy("start", "end")
    new = F.coalesce(F.col("start") - F.lag("end").over(w) > gap, F.lit(True))
    marked = regions.withColumn("__i", F.sum(F.when(new, 1).otherwise(0)).over(w))
    return marked.groupBy(*keys, "__i").agg(F.min("start").alias("start"), F.max_by("end", F.struct("start", "end")).alias("end")).drop("__i")


def sessions(rows: DataFrame, keys: list[str], at: str, gap: float) -> DataFrame:
    """Runs of positions no further apart than ``gap``: (start, end, n)."""
    w = Window.partitionBy(*keys).orderBy(at)
    new = F.coalesce(F.col(at) - F.lag(at).over(w) >= gap, F.lit(True))
    marked = rows.withColumn("__i", F.sum(F.when(new, 1).otherwise(0)).over(w))
    return marked.groupBy(*keys, "__i").agg(F.min(at).alias("start"), F.max(at).alias("end"), F.count("*").alias("n")).drop("__i")


def pad_and_filter(regions: DataFrame, pad: float, shortest: float, total: Column) -> DataFrame:
    start, end = F.greatest(F.lit(0.0), F.col("start") - pad), F.least(total, F.col("end") + pad)
    return regions.withColumn("start", start).withColumn("end", end).where(F.col("end") - F.col("start") >= shortest)


def equal_slices(start, end, count) -> Column:
    """``count`` equal regions of an interval as an array; the last ends exactly at ``end``."""
    n = F.greatest(F.lit(1), F.floor(col(count) + 0.5)).cast("int")
    step = F.greatest(F.lit(0.0), col(end) - col(start)) / n
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: _region(col(start) + i * step, F.when(i == n - 1, col(end)).otherwise(col(start) + (i + 1) * step)))


def split_at(regions, t, shortest: float) -> Column:
    """The region that holds ``t`` in two; null where none does or a side would be too short."""
    r, t = col(regions), col(t)
    where = F.array_position(F.transform(r, lambda x: (t >= x.start) & (t <= x.end)), F.lit(True)).cast("int")
    hit = F.get(r, where - 1)
    ok = (where > 0) & (t - hit.start >= shortest) & (hit.end - t >= shortest)
    parts = F.concat(F.slice(r, F.lit(1), where - 1), F.array(_region(hit.start, t), _region(t, hit.end)), F.slice(r, where + 1, F.size(r)))
    return F.when(ok, parts)


def add_or_split(regions, t, shortest: float, duration) -> Column:
    """As split_at inside a region; outside, a new one up to the next region or the end."""
    r, t = col(regions), col(t)
    inside = F.exists(r, lambda x: (t >= x.start) & (t <= x.end))
    before, after = F.filter(r, lambda x: x.start <= t), F.filter(r, lambda x: x.start > t)
    end = F.when(F.size(after) > 0, F.get(after, F.lit(0)).start).otherwise(col(duration))
    ok = (t >= 0) & (t <= col(duration)) & (end - t >= shortest)
    return F.when(inside, split_at(r, t, shortest)).when(ok, F.concat(before, F.array(_region(t, end)), after))


def splice(existing, start, anchor, new, tolerance: float = 1e-3) -> Column:
    """What lies before the anchor, cut there, followed by the new regions."""
    e, s, a = col(existing), col(start), col(anchor)
    kept = F.filter(e, lambda x: x.start < F.least(s, a) - tolerance)
    kept = F.transform(kept, lambda x: _region(x.start, F.when((x.end >= s - tolerance) | (x.end > a), a).otherwise(x.end)))
    return F.concat(F.array_sort(F.filter(kept, lambda x: x.end - x.start > tolerance)), col(new))


def regions_equal(a, b) -> Column:
    return col(a).eqNullSafe(col(b))


def valid_selection(index, count) -> Column:
    return F.when((col(index) >= 0) & (col(index) < col(count)), col(index))


def resolve(cached, detected) -> Column:
    """An edit that is there beats detection."""
    return F.coalesce(col(cached), col(detected))


def shared_boundaries(edges: DataFrame, keys: list[str], at: str, near: float = 0.006) -> DataFrame:
    """Edges of regions within ``near`` of the one before are one boundary, at the first of them."""
    return sessions(edges, keys, at, near + 1e-12).select(*keys, F.col("start").alias("boundary"), F.col("n").alias("edges"))


def zero_crossing(rows: DataFrame, keys: list[str], at: str, value: str, around: str, window: int) -> DataFrame:
    """Nearest sign change to position ``around`` (a column), the earlier of equally near ones; else the position itself."""
    w = Window.partitionBy(*keys).orderBy(at)
    before = F.lag(value).over(w)
    marked = rows.withColumn("__x", ((before <= 0) & (F.col(value) >= 0)) | ((before >= 0) & (F.col(value) <= 0)))
    near = F.abs(F.col(at) - F.col(around))
    best = F.min(F.when(F.col("__x") & (near <= window), F.struct(near.alias("d"), F.col(at).alias("p"))))
    return marked.groupBy(*keys, around).agg(F.coalesce(best["p"], F.col(around)).alias("crossing"))


SNAP_MODES = ("off", "bar", "half-bar", "beat", "1/2", "1/4", "1/8", "zero")


def snap_mode(value) -> Column:
    """A known mode as it is; true and ``grid`` from older settings, and anything else, are ``bar``; false is ``off``."""
    v = F.lower(F.coalesce(col(value).cast("string"), F.lit("bar")))
    return F.when(v.isin(*SNAP_MODES), v).when(v == "false", F.lit("off")).otherwise(F.lit("bar"))


# an edit history is an append-only table (key, version, regions, selected) and a table of cursors (key, version)


def commit(history: DataFrame, cursors: DataFrame, edits: DataFrame, keys: list[str], limit: int = HISTORY_LIMIT) -> DataFrame:
    """Versions after the cursor go, the edit is appended, and the last ``limit`` versions stay."""
    kept = history.join(cursors.select(*keys, F.col("version").alias("__at")), keys, "left").where("__at is null or version <= __at").drop("__at")
    top = kept.groupBy(*keys).agg(F.max("version").alias("__top"))
    added = edits.join(top, keys, "left").withColumn("version", F.coalesce(F.col("__top") + 1, F.lit(0))).drop("__top")
    every = kept.unionByName(added.select(*kept.columns))
    w = Window.partitionBy(*keys).orderBy(F.desc("version"))
    return every.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= limit).drop("__r")


def can_undo(version, first=0) -> Column:
    return col(version) > col(first)


def can_redo(version, last) -> Column:
    return col(version) < col(last)


def undo(version, first=0) -> Column:
    return F.when(can_undo(version, first), col(version) - 1)


def redo(version, last) -> Column:
    return F.when(can_redo(version, last), col(version) + 1)


def ensure_history(history: DataFrame, baseline: DataFrame, keys: list[str]) -> DataFrame:
    """Version 0 from the baseline for keys without a history."""
    fresh = baseline.join(history.select(*keys).distinct(), keys, "left_anti").withColumn("version", F.lit(0))
    return history.unionByName(fresh.select(*history.columns))


MARKER_LIMIT = 128


def cue_frames(regions, sample_rate, frames) -> Column:
    """Sorted starts of regions as sample positions inside the signal."""
    starts = F.array_sort(F.transform(col(regions), lambda r: r.start))
    return F.transform(starts, lambda s: F.greatest(F.lit(0), F.least(F.greatest(F.lit(0), col(frames) - 1), F.floor(s * col(sample_rate) + 0.5))).cast("int"))


def markers_ok(count) -> Column:
    return col(count) <= MARKER_LIMIT
