"""Beat grids from tables of onsets and hits: tempo and phase, alignment, and votes on bars."""

from __future__ import annotations

import math
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sonarframe.work import table

TURN = 2 * math.pi
#: Share of the estimate that a tempo may be off, and candidates of a scan to each side.
RANGE, STEPS = 0.01, 20
#: Onsets further than that from their line, in the units of time, are left out of the second fit of a pass; a pass looks so far.
PASSES = ((0.04, 0.008), (0.015, 0.008))
LEAST_COHERENCE, LEAST_POINTS, MOST_SHIFT = 0.15, 8, 0.02


def _on(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on keys, nulls equal; ``right``'s other columns are new."""
    other = right.select(*(F.col(k).alias(f"__of_{k}") for k in keys), *(c for c in right.columns if c not in keys))
    on = F.lit(True)
    for k in keys:
        on &= F.col(k).eqNullSafe(F.col(f"__of_{k}"))
    return left.join(other, on, how).drop(*(f"__of_{k}" for k in keys))


def _scan(onsets: DataFrame, keys: list[str], at: str, strength: str, centre: str, reach: Column, steps: int) -> DataFrame:
    """(keys, beat, phase, coherence) of the best of 2 * steps + 1 beats around ``centre``, at half a beat; candidates are columns of one aggregation.

    ``centre`` is a column of ``onsets``, the same in a key; candidate i is centre + reach * i / steps; of equals the first wins.
    """
    t, v = F.col(at), F.col(strength)
    beat = lambda i: F.col(centre) + reach * (i / steps)
    sums = [F.sum(v).alias("__total"), F.min(centre).alias(centre), F.min(reach).alias("__reach")]
    for i in range(-steps, steps + 1):
        w = TURN / (beat(i) / 2)
        sums += [F.sum(v * F.cos(w * t)).alias(f"__re{steps + i}"), F.sum(v * F.sin(w * t)).alias(f"__im{steps + i}")]
    found = onsets.groupBy(*keys).agg(*sums).where("__total > 0")
    every = []
    for i in range(-steps, steps + 1):
        re, im, period = F.col(f"__re{steps + i}"), F.col(f"__im{steps + i}"), (F.col(centre) + F.col("__reach") * (i / steps)) / 2
        every.append(F.struct((F.hypot(re, im) / F.col("__total")).alias("coherence"), F.lit(-i).alias("i"), (2 * period).alias("beat"), F.pmod(F.atan2(im, re) / TURN * period, period).alias("phase")))
    best = found.select(*keys, F.array_max(F.array(*every)).alias("__best"))
    return best.select(*keys, "__best.beat", "__best.phase", "__best.coherence")


def _near_lines(rows: DataFrame, grid: DataFrame, keys: list[str], reach: float) -> DataFrame:
    """The strongest onset near each line of the grid, the earliest of equals: (keys, __k, __t, __v, __top)."""
    k = F.floor((F.col("__t") - F.col("phase")) / F.col("beat") + 0.5)
    rows = _on(rows, grid.select(*keys, "beat", "phase"), keys).withColumn("__k", k)
    rows = rows.where(F.abs(F.col("__t") - (F.col("phase") + F.col("beat") * F.col("__k"))) <= F.least(F.lit(reach), F.col("beat") / 6))
    best = rows.groupBy(*keys, "__k").agg(F.min(F.struct((-F.col("__v")).alias("v"), F.col("__t").alias("t"), F.col("__top").alias("top"))).alias("__m"))
    return best.select(*keys, "__k", F.col("__m.t").alias("__t"), (-F.col("__m.v")).alias("__v"), F.col("__m.top").alias("__top"))


def _line(points: DataFrame, keys: list[str], suffix: str) -> DataFrame:
    """Slope and intercept of each key's points, where there are enough."""
    found = points.groupBy(*keys).agg(F.regr_slope("__t", "__k").alias(f"__slope{suffix}"), F.regr_intercept("__t", "__k").alias(f"__at{suffix}"), F.count("*").alias(f"__points{suffix}"))
    return found.where((F.col(f"__points{suffix}") >= LEAST_POINTS) & F.col(f"__slope{suffix}").isNotNull())


def _lower_quantile(rows: DataFrame, keys: list[str], value: str, share: float, least: int) -> DataFrame:
    """(keys, value) at rank floor(n * share) for keys with ``least`` rows; equal values are counted first."""
    w = Window.partitionBy(*keys)
    counts = rows.groupBy(*keys, value).agg(F.count("*").alias("__n"))
    counts = counts.withColumn("__upto", F.sum("__n").over(w.orderBy(value))).withColumn("__all", F.sum("__n").over(w))
    return counts.where((F.col("__all") >= least) & (F.col("__upto") > F.floor(F.col("__all") * share))).groupBy(*keys).agg(F.min(value).alias(value))


def fit(onsets: DataFrame, keys: list[str], at: str, strength: str, estimate: str, steps: int = STEPS, passes: tuple = PASSES, loud: float = 0.35) -> DataFrame:
    """(keys, beat, phase, coherence, points): the beat, and the phase within it, that a key's onsets keep to.

    ``estimate`` is a column with the beat that is looked around, the same in a key.  Two
    scans of phasors over half beats, coarse and then fine, give beat and phase; whether on
    or off the beat is what the phasor at a whole beat is nearer to.  Each pass fits a line
    through the strongest onset near each grid line, leaves out what is off that line and
    fits again, if 8 points stay and the slope is within 1.5 % of the estimate.  Last, the
    25th percentile of how far loud onsets (``loud`` of the key's strongest) are off moves the
    phase, by 20 ms at most.  Onsets are written once and read by each step, whose results are small tables.  Keys without a pulse (a coherence under 0.15) or with fewer than 8 onsets have no row.
    """
    rows = onsets.where((F.col(strength) > 0) & F.col(at).isNotNull()).select(*keys, F.col(at).cast("double").alias("__t"), F.col(strength).cast("double").alias("__v"), F.col(estimate).cast("double").alias("__est"))
    some = rows.groupBy(*keys).agg(F.count("*").alias("__n"), F.max("__v").alias("__top")).where(F.col("__n") >= LEAST_POINTS).drop("__n")
    rows = table(_on(rows, some, keys), "onsets")
    coarse = _scan(rows, keys, "__t", "__v", "__est", F.col("__est") * RANGE, steps).select(*keys, F.col("beat").alias("__coarse"))
    coarse = table(coarse, "coarse")
    scanned = _scan(_on(rows, coarse, keys), keys, "__t", "__v", "__coarse", F.col("__est") * (RANGE / steps), steps).where(F.col("coherence") >= LEAST_COHERENCE)
    scanned = table(scanned, "fine")

    w = TURN / F.col("beat")
    whole = _on(rows, scanned, keys).groupBy(*keys).agg(F.sum(F.col("__v") * F.cos(w * F.col("__t"))).alias("__re"), F.sum(F.col("__v") * F.sin(w * F.col("__t"))).alias("__im"), *(F.min(c).alias(c) for c in ("beat", "phase", "coherence", "__est")))
    on, off = F.col("phase"), F.col("phase") + F.col("beat") / 2
    points = F.atan2("__im", "__re") / TURN * F.col("beat")
    far = lambda p: F.abs(F.pmod(p - points + F.col("beat") / 2, F.col("beat")) - F.col("beat") / 2)
    grid = whole.select(*keys, "beat", F.pmod(F.when(far(on) <= far(off), on).otherwise(off), F.col("beat")).alias("phase"), "coherence", "__est", F.lit(0).cast("long").alias("points"))
    grid = table(grid, "grid")

    rows = rows.select(*keys, "__t", "__v", "__top")
    for reach, most in passes:
        near = _near_lines(rows, grid, keys, reach)
        first = _on(near, _line(near, keys, "1"), keys)
        second = _line(first.where(F.abs(F.col("__t") - (F.col("__at1") + F.col("__slope1") * F.col("__k"))) <= most), keys, "2")
        better = F.coalesce(F.abs(F.col("__slope2") / F.col("__est") - 1) <= RANGE * 1.5, F.lit(False))
        pick = lambda new, old: F.when(better, F.col(new)).otherwise(F.col(old)).alias(old)
        grid = _on(grid, second, keys, "left").select(*keys, pick("__slope2", "beat"), pick("__at2", "phase"), "coherence", "__est", pick("__points2", "points"))
        grid = table(grid, "grid")

    last = _on(_near_lines(rows, grid, keys, passes[-1][0]).where(F.col("__v") >= F.col("__top") * loud), grid.select(*keys, "beat", "phase"), keys)
    away = last.withColumn("__away", F.col("__t") - (F.col("phase") + F.col("beat") * F.col("__k"))).select(*keys, "__away")
    found = _on(grid, _lower_quantile(away, keys, "__away", 0.25, 4), keys, "left")
    shift = F.when(F.abs("__away") <= MOST_SHIFT, F.col("__away")).otherwise(0.0)
    return found.select(*keys, "beat", F.pmod(F.col("phase") + shift, F.col("beat")).alias("phase"), "coherence", "points")


def fold(frames: DataFrame, keys: list[str], at: str, value: str, period: float) -> DataFrame:
    """(keys, offset, confidence): where in a period of so many frames a key's values pile up, and how clearly.

    The score of an offset is the sum of the values at it in every whole period, between frames
    by linear interpolation, round the end; there are as many offsets as the period has frames.
    An offset past half a period counts back from the next; confidence is the best score over the mean.  A frame
    adds to the few places around it, so nothing is joined and a key's frames are added up wherever they are.
    Places are integers from 0 on; keys with fewer than two periods, or nothing positive in sum, have no row.
    """
    if not period >= 2:
        raise ValueError("a period has two frames at least")
    steps = max(2, math.floor(period + 0.5))
    d = period / steps
    sizes = frames.groupBy(*keys).agg((F.max(at) + 1).alias("__n"), F.sum(value).alias("__sum")).where((F.col("__n") >= 2 * period) & (F.col("__sum") > 0)).drop("__sum")
    rows = _on(frames.select(*keys, F.col(at).cast("long").alias("__i"), F.col(value).cast("double").alias("__v")), sizes, keys)
    places = F.when(F.col("__i") == 0, F.array(F.lit(0), F.col("__n"))).otherwise(F.array(F.col("__i")))  # the first frame follows the last
    rows = rows.select(*keys, "__n", "__v", F.explode(places).alias("__p"))
    low, high = F.greatest(F.lit(0), F.floor((F.col("__p") - 1) / d) + 1), F.ceil((F.col("__p") + 1) / d) - 1
    last = F.floor(F.col("__n") / period) * steps - 1
    high = F.least(high, last).cast("long")
    rows = rows.withColumn("__low", low.cast("long")).withColumn("__high", high).where("__low <= __high")
    rows = rows.select(*keys, "__v", "__p", F.explode(F.sequence("__low", "__high")).alias("__q"))
    scores = rows.groupBy(*keys, F.pmod("__q", F.lit(steps)).alias("__s")).agg(F.sum(F.col("__v") * (1 - F.abs(F.col("__q") * d - F.col("__p")))).alias("__score"))
    best = scores.groupBy(*keys).agg(F.min(F.struct((-F.col("__score")).alias("score"), F.col("__s").alias("s"))).alias("__b"), (F.sum("__score") / steps).alias("__mean"))
    offset = F.col("__b.s") * d
    return best.select(*keys, F.when(offset > period / 2, offset - period).otherwise(offset).alias("offset"), F.when(F.col("__mean") > 0, -F.col("__b.score") / F.col("__mean")).otherwise(0.0).alias("confidence"))


#: How near to a beat a hit counts for it, in beats; the least peak that does; least number of snares.
NEAR, LEAST_PEAK = 0.14, 0.2


def _weight(peak: str, strength: str) -> Column:
    return F.col(peak) * (0.5 + F.col(strength))


def rotation_pairs(hits: DataFrame, keys: list[str], onset: str, peak: str, strength: str, beat: str, anchor: str) -> DataFrame:
    """(keys, score): how well snares fall on 2 and 4 of the same bars, best over eight half-beat rotations, a second.

    ``hits`` are snares with columns for the beat and the time that rotations start from.  A bar counts
    with the lesser of its two backbeats; snares on 1 and 3 count against it, by 0.6.
    """
    rows = hits.where(F.col(peak) >= LEAST_PEAK).withColumn("__r", F.explode(F.sequence(F.lit(0), F.lit(7))))
    rows = rows.withColumn("__at", (F.col(onset) - (F.col(anchor) + F.col("__r") * F.col(beat) / 2)) / F.col(beat))
    rows = rows.withColumn("__bar", F.floor(F.col("__at") / 4)).withColumn("__pos", F.col("__at") - F.floor(F.col("__at") / 4) * 4)
    near = lambda target: (F.abs(F.col("__pos") - target) <= NEAR) | (F.abs(F.col("__pos") - target - 4) <= NEAR)
    w = _weight(peak, strength)
    on = F.when(near(1), 1).when(near(3), 3).when(near(0) | near(2), 0)
    bars = rows.withColumn("__on", on).groupBy(*keys, beat, "__r", "__bar").agg(
        F.coalesce(F.max(F.when(F.col("__on") == 1, w)), F.lit(0.0)).alias("two"), F.coalesce(F.max(F.when(F.col("__on") == 3, w)), F.lit(0.0)).alias("four"), F.coalesce(F.sum(F.when(F.col("__on") == 0, w)), F.lit(0.0)).alias("wrong"),
    )
    turns = bars.groupBy(*keys, beat, "__r").agg((F.sum(F.least("two", "four")) - 0.6 * F.sum("wrong")).alias("s"))
    return turns.groupBy(*keys, beat).agg(F.max("s").alias("s")).select(*keys, F.col(beat), (F.col("s") / F.greatest(F.lit(1.0), 4 * F.col(beat))).alias("score"))


def tempo_octave(hits: DataFrame, keys: list[str], onset: str, peak: str, strength: str, label: str, bpm: str) -> DataFrame:
    """(keys, bpm): the tempo, or twice or half of it (from 60 to 220) if the snares' backbeat fits that clearly better.

    Clearly is 1.5 times the score and 0.05 more, with three snares at least; rotations start from the key's first hit.
    """
    per = hits.groupBy(*keys).agg(F.min(onset).alias("__anchor"), F.min(bpm).alias("__bpm"), F.count_if((F.col(label) == "snare") & (F.col(peak) >= LEAST_PEAK)).alias("__snares"))
    tempi = F.filter(F.array(*(F.struct(F.lit(i).alias("i"), (F.col("__bpm") * by).alias("b")) for i, by in enumerate((1.0, 2.0, 0.5)))), lambda x: (x.i == 0) | ((x.b >= 60) & (x.b <= 220)))
    asked = per.where((F.col("__bpm") > 0) & (F.col("__snares") >= 3)).select(*keys, "__anchor", F.explode(tempi).alias("__x")).select(*keys, "__anchor", F.col("__x.i").alias("__i"), (60 / F.col("__x.b")).alias("__beat"), F.col("__x.b").alias("__b"))
    snares = _on(hits.where(F.col(label) == "snare").select(*keys, F.col(onset).alias("__o"), F.col(peak).alias("__p"), F.col(strength).alias("__s")), asked, keys)
    scores = rotation_pairs(snares, [*keys, "__i", "__b"], "__o", "__p", "__s", "__beat", "__anchor")
    best = scores.groupBy(*keys).agg(F.max(F.struct("score", (-F.col("__i")).alias("i"), F.col("__b").alias("b"))).alias("__m"), F.max(F.when(F.col("__i") == 0, F.col("score"))).alias("__now"))
    clear = (F.col("__m.i") != 0) & (F.col("__m.score") > 0) & (F.col("__m.score") >= F.col("__now") * 1.5 + 0.05)
    return _on(per, best, keys, "left").select(*keys, F.when(F.coalesce(clear, F.lit(False)), F.col("__m.b")).otherwise(F.col("__bpm")).alias("bpm"))


def bar_vote(hits: DataFrame, keys: list[str], onset: str, peak: str, strength: str, label: str, beat: str, downbeat: str) -> DataFrame:
    """(keys, downbeat): the downbeat, or one of seven half-beat shifts of it (within a bar) that the hits speak for.

    Snares on 2 and 4 count, on 1 and 3 against by 0.6; kicks on 1 by 0.5 and on 3 by 0.25.  A shift wins with 0.6 and 30 % more,
    or as good and nearer to a bar line at 0; a key with fewer than two snares keeps its downbeat.
    What a hit counts is added and compared as a decimal of 12 places: floating-point sums depend on the order of the hits, and
    would decide at random about a shift that is better by just 0.6.  A hit whose weight isn't finite counts nothing.
    """
    loud = F.col(peak) >= LEAST_PEAK
    rows = hits.withColumn("__w", F.when(loud, _weight(peak, strength)))
    columns = []
    for k in range(8):
        pos = F.pmod((F.col(onset) - (F.col(downbeat) + F.col(beat) * (k / 2))) / F.col(beat), F.lit(4.0))
        near = lambda target, pos=pos: F.least(F.abs(pos - target), 4 - F.abs(pos - target)) <= NEAR
        gain = F.when(F.col(label) == "snare", F.when(near(1) | near(3), 1.0).when(near(0) | near(2), -0.6)).when(F.col(label) == "kick", F.when(near(0), 0.5).when(near(2), 0.25))
        columns.append(F.coalesce(F.sum((gain * F.col("__w")).try_cast("decimal(24,12)")), F.lit(0).cast("decimal(34,12)")).alias(f"__s{k}"))
    per = rows.groupBy(*keys).agg(F.min(beat).alias("__beat"), F.min(downbeat).alias("__down"), F.count_if((F.col(label) == "snare") & loud).alias("__snares"), *columns)
    bar = F.col("__beat") * 4
    shift = lambda k: F.col("__down") + F.col("__beat") * (k / 2)
    edge = lambda d: F.least(F.pmod(d, bar), bar - F.pmod(d, bar))
    every = F.array(*(F.struct(shift(k).alias("d"), F.col(f"__s{k}").alias("s"), edge(shift(k)).alias("edge"), F.lit(True).alias("moved")) for k in range(1, 8)))
    start = F.struct(F.col("__down").alias("d"), F.col("__s0").alias("s"), edge(F.col("__down")).alias("edge"), F.lit(False).alias("moved"))
    same = F.lit(Decimal("0.000001"))
    wins = lambda best, x: (x.s > best.s + same) | ((F.abs(x.s - best.s) <= same) & best.moved & (x.edge < best.edge))
    best = per.withColumn("__b", F.aggregate(every, start, lambda best, x: F.when(wins(best, x), x).otherwise(best)))
    better = F.col("__b.s") >= F.col("__s0") + F.greatest(F.lit(Decimal("0.6")), F.abs("__s0") * Decimal("0.3"))
    tied = (F.abs(F.col("__b.s") - F.col("__s0")) <= same) & (F.col("__b.edge") + 0.01 < edge(F.col("__down")))
    change = (F.col("__snares") >= 2) & F.col("__b.moved") & (better | tied)
    return best.select(*keys, F.when(change, F.pmod(F.col("__b.d"), bar)).otherwise(F.col("__down")).alias("downbeat"))
