"""Aggregates over frames, hits and samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sonarframe.functions.columns import col, let
from sonarframe.functions.levels import LOUDNESS_FLOOR_DB, to_db


def rms(x) -> Column:
    return F.coalesce(F.sqrt(F.avg(col(x) * col(x))), F.lit(0.0))


def peak(x) -> Column:
    return F.max(F.abs(col(x)))


def phasor(rows: DataFrame, keys: list[str], at: str, value: str, period: float) -> DataFrame:
    """Weighted circular mean at a period: (coherence, phase)."""
    w = 2 * 3.141592653589793 / period
    t, v = F.col(at), F.col(value)
    sums = rows.groupBy(*keys).agg(F.sum(v * F.cos(w * t)).alias("re"), F.sum(v * F.sin(w * t)).alias("im"), F.sum(v).alias("total"))
    phase = F.atan2("im", "re") / w
    phase = phase - period * F.floor(phase / period)
    return sums.select(*keys, F.when(F.col("total") > 0, F.sqrt(F.col("re") * F.col("re") + F.col("im") * F.col("im")) / F.col("total")).otherwise(0.0).alias("coherence"), phase.alias("phase"))


def phasor_scan(rows: DataFrame, keys: list[str], at: str, value: str, periods: list[float]) -> DataFrame:
    """The period with the largest coherence: candidates are columns of one aggregation, so rows aren't multiplied."""
    t, v = F.col(at), F.col(value)
    sums = [F.sum(v).alias("total")]
    for i, p in enumerate(periods):
        w = 2 * 3.141592653589793 / p
        sums += [F.sum(v * F.cos(w * t)).alias(f"re{i}"), F.sum(v * F.sin(w * t)).alias(f"im{i}")]
    found = rows.groupBy(*keys).agg(*sums)
    every = F.array(*(F.struct((F.hypot(F.col(f"re{i}"), F.col(f"im{i}")) / F.col("total")).alias("coherence"), F.lit(-i).alias("i"), F.lit(p).alias("period")) for i, p in enumerate(periods)))
    return found.where("total > 0").select(*keys, F.array_max(every).alias("best")).select(*keys, "best.coherence", "best.period")


def line(rows: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """Least squares: (slope, intercept)."""
    return rows.groupBy(*keys).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"))


def gated_loudness(frames: DataFrame, keys: list[str], rms_col: str = "rms", gate_db: float = -25.0) -> DataFrame:
    """Mean square of frames no more than 25 dB under the loudest one, in dB; null for silence."""
    top = frames.groupBy(*keys).agg(F.max(rms_col).alias("__top")).where("__top > 0")
    kept = frames.join(top, keys).where(F.col(rms_col) >= F.greatest(F.lit(1e-5), F.col("__top") * 10 ** (gate_db / 20)))
    loud = kept.groupBy(*keys).agg(to_db(F.sqrt(F.avg(F.col(rms_col) * F.col(rms_col))), LOUDNESS_FLOOR_DB).alias("loudness_db"))
    return frames.select(*keys).distinct().join(loud, keys, "left")


def safety(x) -> list[Column]:
    """NaN and infinity flags, peak, rms, dc, near silence and extreme dc, over finite samples."""
    v = col(x).cast("double")
    finite = F.when(~F.isnan(v) & (F.abs(v) < float("inf")), v)
    level, dc = F.coalesce(F.sqrt(F.avg(finite * finite)), F.lit(0.0)), F.coalesce(F.avg(finite), F.lit(0.0))
    return [
        F.coalesce(F.bool_or(F.isnan(v)), F.lit(False)).alias("has_nan"),
        F.coalesce(F.bool_or(F.abs(v) == float("inf")), F.lit(False)).alias("has_inf"),
        F.coalesce(F.max(F.abs(finite)), F.lit(0.0)).alias("peak"),
        level.alias("rms"),
        dc.alias("dc"),
        (level < 0.0008).alias("near_silent"),
        (F.abs(dc) > 0.35).alias("extreme_dc"),
    ]


def acceptable(has_nan, has_inf, level, novelty) -> Column:
    return ~col(has_nan) & ~col(has_inf) & (col(level) >= 0.0008) & (col(novelty) >= 0.1)


def novelty(original, processed) -> Column:
    """Distance of two arrays after both are brought to unit rms; the smaller of direct and inverted."""
    norm = lambda x: F.greatest(F.lit(1e-9), F.sqrt(F.aggregate(x, F.lit(0.0), lambda s, v: s + v * v) / F.greatest(F.size(x), F.lit(1))))

    def distance(a: Column, b: Column, na: Column, nb: Column) -> Column:
        far = lambda sign: F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: F.coalesce(x, F.lit(0.0)) / na - sign * F.coalesce(y, F.lit(0.0)) / nb), F.lit(0.0), lambda s, d: s + d * d) / F.greatest(F.size(a), F.size(b), F.lit(1)))
        return F.least(far(1), far(-1))

    return let(col(original), lambda a: let(col(processed), lambda b: let(norm(a), lambda na: let(norm(b), lambda nb: distance(a, b, na, nb)))))


def peaks(rows: DataFrame, keys: list[str], at: str, value: str, low: int, high: int, bins: int) -> DataFrame:
    """Largest absolute value in each of ``bins`` spans of positions low..high-1.

    Span b is floor(b * size) to floor((b + 1) * size), one position wide at least, and the last ends at
    ``high``; with more bins than positions, spans share positions.
    """
    spark = rows.sparkSession
    size = (high - low) / bins
    spans = spark.range(bins).select(F.col("id").cast("int").alias("bin"))
    start = F.lit(low) + F.floor(F.col("bin") * size)
    end = F.when(F.col("bin") == bins - 1, F.lit(high)).otherwise(F.greatest(start + 1, F.lit(low) + F.floor((F.col("bin") + 1) * size)))
    spans = spans.select("bin", F.explode(F.sequence(start.cast("long"), end.cast("long") - 1)).alias(at))
    inside = rows.where(F.col(at).between(low, high - 1)).groupBy(*keys, at).agg(F.max(F.abs(value)).alias("__v"))
    found = inside.join(F.broadcast(spans), at).groupBy(*keys, "bin").agg(F.max("__v").alias("peak"))
    every = rows.select(*keys).distinct().crossJoin(F.broadcast(spark.range(bins).select(F.col("id").cast("int").alias("bin"))))
    return every.join(found, [*keys, "bin"], "left").withColumn("peak", F.coalesce("peak", F.lit(0.0)))


def class_shares(rows: DataFrame, keys: list[str], cls: Column, low: str, high: str) -> DataFrame:
    """Per class the share of ``low`` minus the share of ``high``: where a bar's heavy beats are."""
    per = rows.groupBy(*keys, cls.alias("cls")).agg(F.sum(low).alias("l"), F.sum(high).alias("h"))
    total = per.groupBy(*keys).agg(F.sum("l").alias("tl"), F.sum("h").alias("th"))
    share = lambda x, t: F.when(F.col(t) != 0, F.col(x) / F.col(t)).otherwise(F.col(x))
    return per.join(total, keys).select(*keys, "cls", (share("l", "tl") - share("h", "th")).alias("kick"))


def fingerprint(raw) -> Column:
    """Mean-centred and of length 1 (a vector without spread stays 0)."""
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, v: s + v)
    doubles = F.transform(col(raw), lambda v: v.cast("double"))
    centred = let(doubles, lambda x: let(total(x) / F.size(x), lambda mean: F.transform(x, lambda v: v - mean)))
    square = lambda c: F.sqrt(F.aggregate(c, F.lit(0.0), lambda s, v: s + v * v))
    return let(centred, lambda c: let(F.when(square(c) == 0, F.lit(1.0)).otherwise(square(c)), lambda norm: F.transform(c, lambda v: v / norm)))


def classify_hit(low, mid, high, duration) -> Column:
    low, mid, high, d = col(low), col(mid), col(high), col(duration)
    total = F.when(low + mid + high > 1e-9, low + mid + high)
    lo, mi, hi = low / total, mid / total, high / total
    return F.when(total.isNull(), F.lit("perc")).when((lo >= 0.5) & (d < 0.5), F.lit("kick")).when(hi >= 0.45, F.when(d < 0.18, F.lit("hat")).otherwise(F.lit("cymbal"))).when((mi >= 0.32) | ((lo < 0.5) & (hi < 0.45)), F.lit("snare")).otherwise(F.lit("perc"))


def looks_percussive(flatness, confidence) -> Column:
    f, c = col(flatness), col(confidence)
    return F.when(f.isNull() | (f < 0.58), F.lit(False)).when(c.isNull(), f >= 0.66).otherwise(c >= 2.5)


def level_guard(before, after) -> Column:
    """Gain that takes a louder result back to its source's peak."""
    return F.when((col(after) > col(before)) & (col(after) > 0), col(before) / col(after)).otherwise(F.lit(1.0))


def decay_contrast(samples) -> Column:
    """1 - rms of the last third / rms of the first third of an array, within 0..1."""
    x = col(samples)
    n = F.greatest(F.lit(1), F.floor(F.size(x) / 3)).cast("int")
    level = lambda part: F.sqrt(F.aggregate(part, F.lit(0.0), lambda s, v: s + v * v) / n)
    head, tail = level(F.slice(x, F.lit(1), n)), level(F.slice(x, -n, n))
    return F.when(head > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - tail / head))).otherwise(F.lit(0.0))


def backbeat_score(hits: DataFrame, keys: list[str], at: str, score: str, beat: float, downbeat: float, near: float = 0.12) -> DataFrame:
    """Weight of hits on beats 2 and 4 minus half of that on 1 and 3."""
    n = F.floor((F.col(at) - downbeat) / beat + 0.5)
    off = F.abs((F.col(at) - downbeat) / beat - n)
    cls = F.pmod(n, F.lit(4))
    weight = F.when(off <= near, F.when(cls.isin(1, 3), F.col(score)).otherwise(-0.5 * F.col(score))).otherwise(0.0)
    return hits.groupBy(*keys).agg(F.sum(weight).alias("backbeat"))


def departure(changed) -> Column:
    """Share of steps that are changed."""
    return F.coalesce(F.avg(col(changed).cast("int")), F.lit(0.0))


def mix_peaks(tracks: DataFrame, at: str, value: str, gain: str, track: str, length: int, bins: int) -> DataFrame:
    """Tracks repeated to the mix's length, gained, summed and divided by the root of their number; peak per bin."""
    spark = tracks.sparkSession
    sizes = tracks.groupBy(track).agg((F.max(at) + 1).alias("__len"))
    places = sizes.select(track, "__len", F.explode(F.sequence(F.lit(0), F.lit(length - 1))).alias("__i")).withColumn(at, F.col("__i") % F.col("__len"))
    n = F.sqrt(F.lit(float(max(1, sizes.count()))))
    mixed = places.join(tracks, [track, at]).groupBy("__i").agg((F.sum(F.col(value) * F.col(gain)) / n).alias("__v"))
    return mixed.groupBy(F.floor(F.col("__i") * bins / length).cast("int").alias("bin")).agg(F.max(F.abs("__v")).alias("peak"))
