"""Phrases of a recording from its table of frames: runs of playing, cut where the line falls and something new begins.

Everything is joins, windows and rounds over frames and onsets; no array holds a key's signal.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sonarframe.operators import intervals, selection
from sonarframe.operators.frames import percentile
from sonarframe.work import table

#: How far under the loud part of a recording (its 90th percentile) playing goes, in dB, and the score that makes a boundary.
DROP, BOUNDARY = 26.0, 2.5


def _meets(left: DataFrame, right: DataFrame, keys: list[str], on, how: str = "inner") -> DataFrame:
    """``right``'s keys are named __of_key; nulls are equal."""
    for k in keys:
        on &= F.col(k).eqNullSafe(F.col(f"__of_{k}"))
    return left.join(right, on, how)


def runs(frames: DataFrame, keys: list[str], at: str, db: str, rest: float, drop: float = DROP) -> DataFrame:
    """(keys, start, end): stretches whose levels are within ``drop`` of the key's loud part; rests shorter than ``rest`` frames don't end one."""
    sounding = frames.where(F.col(db) > -180)
    loud = percentile(sounding, keys, db, 0.9, "__loud").select(*(F.col(k).alias(f"__of_{k}") for k in keys), "__loud")
    gated = _meets(frames.select(*keys, at, db), loud, keys, F.lit(True))
    return intervals.islands(gated, keys, at, F.col(db) >= F.col("__loud") - drop, 1.0, rest).select(*keys, F.col("start").cast("double").alias("start"), F.col("end").cast("double").alias("end"))


def regions(
    frames: DataFrame, onsets: DataFrame, keys: list[str], at: str, db: str, strength: str, *, rest: float, shortest: float, longest: float, preferred: float,
    spacing: float, back: int, deep: float, long: int, reference: int, drop: float = DROP, boundary: float = BOUNDARY,
) -> DataFrame:
    """(keys, start, end): the phrases of each key, in frames.

    Runs of playing (``runs``) of one and a half times ``shortest`` or more are cut at
    onsets that score ``boundary`` (``selection.boundary_scores``), best first, ``spacing`` from each other and from the run's
    ends; what is then over ``longest`` is cut where that is least bad (``selection.cut_long``).  Shorter runs are phrases of their own.
    """
    found = table(runs(frames, keys, at, db, rest, drop), "runs")
    scored = table(selection.boundary_scores(frames, onsets, keys, at, db, strength, back, deep, long, reference), "scored")
    whole = found.where(F.col("end") - F.col("start") < shortest * 1.5)
    work = found.where(F.col("end") - F.col("start") >= shortest * 1.5)
    spread = work.select(*(F.col(k).alias(f"__of_{k}") for k in keys), F.col("start").alias("__a"), F.col("end").alias("__z"), F.explode(F.sequence(F.floor(F.col("start") / longest), F.floor(F.col("end") / longest))).alias("__b"))
    inside = (F.floor(F.col(at) / longest) == F.col("__b")) & (F.col(at) > F.col("__a") + spacing) & (F.col(at) < F.col("__z") - spacing) & (F.col("score") >= boundary)
    candidates = _meets(scored, spread, keys, inside).select(*keys, F.col(at).cast("double").alias("__t"), "score")
    cuts = selection.spaced(candidates, keys, "__t", "score", spacing)

    # each run's start and the cuts, every one up to the next of them or its run's end
    marks = work.select(*keys, F.col("start").alias("__t"), F.col("end").alias("__end")).unionByName(cuts.select(*keys, "__t", F.lit(None).cast("double").alias("__end")))
    w = Window.partitionBy(*keys).orderBy("__t")
    marks = marks.withColumn("__own", F.last("__end", True).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("__next", F.lead("__t").over(w))
    pieces = marks.select(*keys, F.col("__t").alias("start"), F.least(F.col("__own"), F.coalesce("__next", "__own")).alias("end"))
    return whole.unionByName(selection.cut_long(table(pieces, "pieces"), scored, frames, keys, at, "score", db, shortest, longest, preferred))
