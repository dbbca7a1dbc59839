"""Time series of frames: envelopes, floors, onsets.

A frame table has a key (recording, user, ...), a position and a value.  Windows
are partitioned by the key, so series are computed apart and never meet in a task
unless one key holds them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sonarframe.functions.columns import col
from sonarframe.functions.levels import to_db

ONSET_SHARE, ONSET_LEAST = 0.82, 0.025


def envelope(rows: DataFrame, keys: list[str], at: str, value: str, hops: int = 1, out: str = "rms") -> DataFrame:
    """Hopping root mean square: frame ``i`` covers positions at..at+hops-1 that exist (partial ones at the end stay).

    ``rows`` has one row per hop with the sum of squares (``value``_sq) and count (``value``_n): partial aggregates, so
    samples are reduced before any window.
    """
    w = Window.partitionBy(*keys).orderBy(at).rangeBetween(0, hops - 1)
    return rows.withColumn(out, F.sqrt(F.sum(f"{value}_sq").over(w) / F.sum(f"{value}_n").over(w)))


def hop_sums(samples: DataFrame, keys: list[str], hop: Column, value: str) -> DataFrame:
    """Per key and hop: sum of squares and count, with map-side aggregation."""
    return samples.groupBy(*keys, hop.alias("hop")).agg(F.sum(F.col(value) * F.col(value)).alias(f"{value}_sq"), F.count(value).alias(f"{value}_n"))


def ranked_value(rows: DataFrame, keys: list[str], value: str, share: float, of_last: bool, out: str, empty: float) -> DataFrame:
    """Per key the value at rank floor(n * share), or floor((n - 1) * share), counted from 0.

    Ranks go through value counts, so a key's rows are reduced to its distinct values first.
    """
    counts = rows.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("__n"))
    w = Window.partitionBy(*keys)
    counts = counts.withColumn("__upto", F.sum("__n").over(w.orderBy(value))).withColumn("__all", F.sum("__n").over(w))
    rank = F.least(F.col("__all") - 1, F.floor((F.col("__all") - F.lit(1 if of_last else 0)) * F.lit(share)))
    found = counts.where(F.col("__upto") > rank).groupBy(*keys).agg(F.min(value).alias(out))
    return rows.select(*keys).distinct().join(found, keys, "left").withColumn(out, F.coalesce(out, F.lit(empty))) if keys else found


def noise_floor(rows: DataFrame, keys: list[str], db: str, share: float = 0.10, out: str = "floor_db") -> DataFrame:
    """10th percentile of frame levels in dB (rank floor(n * share)); -60 for no frames."""
    return ranked_value(rows, keys, db, share, False, out, -60.0)


def percentile(rows: DataFrame, keys: list[str], value: str, share: float, out: str = "value") -> DataFrame:
    """Value at rank floor((n - 1) * share); 0 for no rows."""
    return ranked_value(rows, keys, value, share, True, out, 0.0)


def onset_curve(rows: DataFrame, keys: list[str], at: str, value: str, out: str = "strength") -> DataFrame:
    """Rise of log10(value + 1) against the frame before, never negative; 0 for the first."""
    w = Window.partitionBy(*keys).orderBy(at)
    level = F.log10(F.col(value) + 1)
    return rows.withColumn(out, F.greatest(F.lit(0.0), F.coalesce(level - F.lag(level).over(w), F.lit(0.0))))


def combined_onset_curve(rows: DataFrame, keys: list[str], at: str, bands: list[str], out: str = "strength") -> DataFrame:
    """Sum over bands of the onset curve divided by its own 82nd percentile."""
    for b in bands:
        rows = onset_curve(rows, keys, at, b, f"__{b}")
        norm = percentile(rows, keys, f"__{b}", ONSET_SHARE, f"__norm_{b}")
        rows = rows.join(norm, keys)
    total = sum((F.col(f"__{b}") / F.greatest(F.lit(1e-6), F.col(f"__norm_{b}")) for b in bands), F.lit(0.0))
    return rows.withColumn(out, total).drop(*(f"__{b}" for b in bands), *(f"__norm_{b}" for b in bands))


def onset_peaks(rows: DataFrame, keys: list[str], at: str, strength: str, sensitivity: float = 0.65) -> DataFrame:
    """Frames no lower than both neighbours and the threshold max(0.025, 82nd percentile * sensitivity); ends are out."""
    w = Window.partitionBy(*keys).orderBy(at)
    limit = percentile(rows, keys, strength, ONSET_SHARE, "__limit")
    s = F.col(strength)
    marked = rows.withColumn("__before", F.lag(strength).over(w)).withColumn("__after", F.lead(strength).over(w)).join(limit, keys)
    peak = (s >= F.greatest(F.lit(ONSET_LEAST), F.col("__limit") * sensitivity)) & (s >= F.col("__before")) & (s >= F.col("__after"))
    return marked.where(peak).drop("__before", "__after", "__limit")


def debounce(times: Column, spacing: float) -> Column:
    """Times of a sorted array that are at least ``spacing`` after the last one kept: a fold, as each depends on what was kept."""
    start = F.array().cast("array<double>")
    keep = lambda a, t: F.when((F.size(a) == 0) | (t - F.coalesce(F.try_element_at(a, F.lit(-1)), F.lit(-999.0)) >= spacing), F.concat(a, F.array(t.cast("double")))).otherwise(a)
    return F.aggregate(col(times), start, keep)


def moving_reference(rows: DataFrame, keys: list[str], at: str, db: str, frames: int, out: str = "reference_db") -> DataFrame:
    """Trailing mean level over ``frames`` frames, without silent ones (-180)."""
    w = Window.partitionBy(*keys).orderBy(at).rowsBetween(1 - frames, 0)
    return rows.withColumn(out, F.avg(F.when(F.col(db) > -180, F.col(db))).over(w))


def peak_normalised_flux(rows: DataFrame, keys: list[str], at: str, value: str, out: str = "flux") -> DataFrame:
    """Positive differences, divided by the key's largest."""
    w = Window.partitionBy(*keys)
    rise = F.greatest(F.lit(0.0), F.coalesce(F.col(value) - F.lag(value).over(w.orderBy(at)), F.lit(0.0)))
    rows = rows.withColumn("__rise", rise).withColumn("__top", F.max("__rise").over(w))
    return rows.withColumn(out, F.when(F.col("__top") > 0, F.col("__rise") / F.col("__top")).otherwise(0.0)).drop("__rise", "__top")


def first_audible(rows: DataFrame, keys: list[str], at: str, value: str, margin: float = 12.0) -> DataFrame:
    """First position whose level is the noise floor plus a margin or more; 0 if none."""
    rows = rows.withColumn("__db", to_db(value))
    floor = noise_floor(rows, keys, "__db")
    return rows.join(floor, keys).groupBy(*keys).agg(F.coalesce(F.min(F.when(F.col("__db") >= F.col("floor_db") + margin, F.col(at))), F.lit(0)).alias("start"))


def first_onset(rows: DataFrame, keys: list[str], at: str, value: str, share: float = 0.2) -> DataFrame:
    """First position at a share of the key's peak."""
    top = rows.groupBy(*keys).agg(F.max(value).alias("__top"))
    return rows.join(top, keys).where((F.col("__top") > 0) & (F.col(value) >= F.col("__top") * share)).groupBy(*keys).agg(F.min(at).alias("first_onset"))


def onset_windows(onsets: DataFrame, keys: list[str], at: str, longest: float = 1.2, bleed: float = 0.09, pre_roll: float = 0.004, shortest: float = 0.05) -> DataFrame:
    """(start, end) of each onset: up to the next one plus some bleed, or the longest hit."""
    w = Window.partitionBy(*keys).orderBy(at)
    t = F.col(at)
    start = F.greatest(F.lit(0.0), t - pre_roll)
    end = F.least(t + longest, F.coalesce(F.lead(at).over(w) + bleed, t + longest))
    return onsets.withColumn("start", start).withColumn("end", F.greatest(end, F.least(t + longest, start + shortest)))


def first_strong(onsets: DataFrame, keys: list[str], at: str, strength: str, least: float = 0.35) -> DataFrame:
    """First onset of some strength, else the first, per key."""
    return onsets.groupBy(*keys).agg(F.coalesce(F.min(F.when(F.col(strength) >= least, F.col(at))), F.min(at), F.lit(0.0)).alias("first"))
