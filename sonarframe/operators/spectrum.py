"""Spectra of frames as sums over a bounded table of cosines and sines.

A frame is a row with an array of samples; a spectrum is a row with an array of powers, so
bins don't multiply rows, and shares of bands and flatness are sums within a row.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sonarframe.functions.columns import col

#: Samples of a frame at most: the table of cosines and sines has size * (size / 2 + 1) of each.
MOST = 4096
#: Added to a power before its logarithm.
LEAST = 1e-12


def framed(rows: DataFrame, keys: list[str], at: str, value: str, size: int, hop: int) -> DataFrame:
    """(keys, frame, samples): frame f has the values at f * hop to f * hop + size - 1, of places that are all there once.

    Places are integers from 0 on.  Each value goes to the frames that hold it and is grouped by frame, so a key's
    rows are spread over tasks.
    """
    first = F.greatest(F.lit(0), F.ceil((F.col(at) - (size - 1)) / hop)).cast("long")
    last = F.floor(F.col(at) / hop).cast("long")
    spread = rows.select(*keys, F.col(at).alias("__i"), F.col(value).cast("double").alias("__v"), F.explode(F.when(last >= first, F.sequence(first, last))).alias("frame"))
    frames = spread.groupBy(*keys, "frame").agg(F.array_sort(F.collect_list(F.struct("__i", "__v"))).alias("__s"))
    whole = (F.size("__s") == size) & (F.array_max("__s.__i") - F.array_min("__s.__i") == size - 1)
    return frames.where(whole).select(*keys, "frame", F.col("__s.__v").alias("samples"))


def hann(samples, size: int) -> Column:
    """Samples under a symmetric Hann window."""
    return F.transform(col(samples), lambda v, i: v * (0.5 - 0.5 * F.cos(2 * F.pi() * i / (size - 1))))


def powers(frames: DataFrame, samples: str, size: int, low: int = 0, high: int | None = None, out: str = "powers") -> DataFrame:
    """``frames`` with the squared magnitudes of bins ``low`` to ``high`` (size / 2) of each frame of ``size`` samples.

    The cosines and sines of all bins are one row that every task gets: sin(x) is cos(x - a quarter turn).
    """
    high = size // 2 if high is None else high
    if not 0 < size <= MOST or not 0 <= low <= high <= size // 2:
        raise ValueError(f"frames of 1 to {MOST} samples, and bins up to half of that")
    wave = lambda k, shift: F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda n: F.cos(2 * math.pi * F.pmod(k * n, F.lit(size)) / size - shift))
    bins = F.transform(F.sequence(F.lit(low), F.lit(high)), lambda k: F.struct(wave(k, 0.0).alias("c"), wave(k, math.pi / 2).alias("s")))
    table = frames.sparkSession.range(1).select(F.lit(size).alias("__size"), bins.alias("__waves"))
    dot = lambda waves: F.aggregate(F.zip_with(F.col(samples), waves, lambda v, w: v * w), F.lit(0.0), lambda total, v: total + v)
    found = frames.join(F.broadcast(table), F.size(samples) == F.col("__size"))
    return found.withColumn(out, F.transform("__waves", lambda w: F.pow(dot(w.c), 2.0) + F.pow(dot(w.s), 2.0))).drop("__size", "__waves")


def total(array) -> Column:
    return F.aggregate(col(array), F.lit(0.0), lambda a, v: a + v)


def flatness(powers) -> Column:
    """Geometric over arithmetic mean of powers: near 1 for noise, near 0 for tones; null for no bins."""
    p = F.transform(col(powers), lambda v: v + LEAST)
    n = F.size(p)
    return F.when(n > 0, F.exp(total(F.transform(p, F.ln)) / n) / (total(p) / n))


def band_shares(powers, edges: list[int]) -> Column:
    """Share of the power in bins edges[i] to edges[i + 1] - 1, an array; zeros for silence."""
    p = col(powers)
    sums = F.array(*(total(F.slice(p, a + 1, b - a)) for a, b in zip(edges, edges[1:])))
    return F.transform(sums, lambda v: F.when(total(p) > 0, v / total(p)).otherwise(F.lit(0.0)))


def mean_flatness(frames: DataFrame, keys: list[str], powers: str, samples: str, least: float = 1e-6) -> DataFrame:
    """(keys, flatness): mean over a key's frames whose energy is ``least`` or more."""
    energy = F.aggregate(F.col(samples), F.lit(0.0), lambda a, v: a + v * v)
    return frames.where(energy >= least).groupBy(*keys).agg(F.avg(flatness(powers)).alias("flatness"))
