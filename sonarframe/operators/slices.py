"""Slice maps and their hierarchy: a signal divided on its musical grid."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sonarframe.functions.columns import col
from sonarframe.functions.numbers import half_up

#: Slices in a bar by subdivision.
SUBDIVISIONS = {"1bar": 1, "1/2bar": 2, "1/4": 4, "1/8": 8, "1/16": 16, "1/32": 32}
SUBDIVISION_LABELS = {"1bar": "1 bar", "1/2bar": "½ bar"}
DEFAULT_SUBDIVISION = "1/16"
MOST_SLICES, LEAST_SLICES, LEAST_SAMPLES, TOLERANCE = 512, 4, 32, 0.02
LEVELS = ("phrase", "bar", "halfBar", "beat", "halfBeat", "slice", "micro")


def per_bar(subdivision) -> Column:
    table = F.create_map(*(F.lit(x) for kv in SUBDIVISIONS.items() for x in kv))
    return F.coalesce(F.try_element_at(table, col(subdivision)), F.lit(SUBDIVISIONS[DEFAULT_SUBDIVISION]))


def per_beat(slices_per_bar, beats_per_bar: int = 4) -> Column:
    return F.greatest(F.lit(1), half_up(col(slices_per_bar) / beats_per_bar)).cast("int")


def metric_strength(index, slices_per_beat, slices_per_bar) -> Column:
    """1 on a downbeat, .75 mid-bar, .55 on a beat, .1 to .35 between by the coarsest division that it's on."""
    i, beat, bar = col(index), col(slices_per_beat), col(slices_per_bar)
    in_bar, in_beat = F.pmod(i, bar), F.pmod(i, beat)
    middle = F.pmod(half_up(bar / beat), F.lit(2)).eqNullSafe(F.lit(0)) & (in_bar * 2 == bar)
    # the largest halving of a beat that divides the offset: beat, beat/2, ... down to 1
    between = F.lit(0.1)
    for power in range(8, 0, -1):
        division = F.floor(beat / (1 << power))
        between = F.when((division >= 1) & (F.pmod(in_beat, F.greatest(division, F.lit(1))) == 0), 0.1 + 0.25 * (division / beat)).otherwise(between)
    return F.when(in_bar == 0, F.lit(1.0)).when(in_beat != 0, between).when(middle, F.lit(0.75)).otherwise(F.lit(0.55))


def slice_count(samples, sample_rate, bpm, bar_slices, beats_per_bar: int = 4) -> Column:
    """struct(count, aligned): rounded to bars, then to beats, within 2 %, else to slices; four bars without a tempo."""
    n = col(bar_slices)
    duration = col(samples) / col(sample_rate)
    wanted = duration / ((60 / F.nullif(col(bpm), F.lit(0.0))) * beats_per_bar / n)
    beat = per_beat(n, beats_per_bar)
    bars, beats = F.greatest(n, half_up(wanted / n) * n), F.greatest(beat, half_up(wanted / beat) * beat)
    close = lambda x: F.abs(wanted - x) / wanted <= TOLERANCE
    timed = (col(bpm) > 0) & (duration > 0)
    count = F.when(timed, F.when(close(bars), bars).when(close(beats), beats).otherwise(F.greatest(F.lit(1), half_up(wanted)))).otherwise(4 * n)
    aligned = F.when(timed, F.when(close(bars), "bar").when(close(beats), "beat").otherwise("slice")).otherwise("bar")
    return F.struct(F.greatest(F.lit(1), F.least(F.lit(MOST_SLICES), count)).cast("int").alias("count"), aligned.alias("aligned"))


def slice_map(files: DataFrame, samples: str = "samples", sample_rate: str = "sample_rate", bpm: str = "bpm", subdivision: str = "subdivision", beats_per_bar: int = 4) -> DataFrame:
    """One row for each slice: bounds, beat, bar, flags and metrical strength."""
    f = files.withColumn("per_bar", per_bar(subdivision)).withColumn("per_beat", per_beat("per_bar", beats_per_bar))
    f = f.withColumn("__c", slice_count(samples, sample_rate, bpm, "per_bar", beats_per_bar)).withColumn("count", F.col("__c.count")).withColumn("aligned", F.col("__c.aligned")).drop("__c")
    f = f.withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("count") - 1)))
    bound = lambda i: half_up(i * F.col(samples) / F.col("count")).cast("long")
    i = F.col("slice")
    return (
        f.withColumn("start_sample", bound(i)).withColumn("end_sample", bound(i + 1))
        .withColumn("beat", F.floor(i / F.col("per_beat"))).withColumn("bar", F.floor(i / F.col("per_bar")))
        .withColumn("is_beat", F.pmod(i, F.col("per_bar")) % F.col("per_beat") == 0).withColumn("is_downbeat", F.pmod(i, F.col("per_bar")) == 0)
        .withColumn("strength", metric_strength(i, "per_beat", "per_bar"))
    )


def readiness(count, samples, shortest, aligned, timed) -> Column:
    """struct(ok, reason, warning)."""
    reason = F.when((col(samples) <= 0) | (col(count) <= 0), F.lit("no audio")).when(col(count) < LEAST_SLICES, F.lit("too few slices")).when(col(shortest) < LEAST_SAMPLES, F.lit("slices too short"))
    warning = F.when(reason.isNotNull(), F.lit(None)).when(~col(timed), F.lit("no tempo: four bars assumed")).when(col(aligned) == "slice", F.lit("not a whole number of bars or beats")).when(col(count) == MOST_SLICES, F.lit("capped"))
    return F.struct(reason.isNull().alias("ok"), reason.alias("reason"), warning.alias("warning"))


def chop_label(subdivision) -> Column:
    """The subdivision as shown: itself but for whole and half bars, empty for none."""
    labels = F.create_map(*(F.lit(x) for kv in SUBDIVISION_LABELS.items() for x in kv))
    return F.coalesce(F.try_element_at(labels, col(subdivision)), col(subdivision), F.lit(""))


def describe(count, bar_slices, bpm) -> Column:
    bars = col(count) / col(bar_slices)
    whole = half_up(bars)
    text = F.when(F.abs(bars - whole) < 0.02, F.concat(whole.cast("string"), F.when(whole == 1, " bar").otherwise(" bars"))).otherwise(F.format_string("%.2f bars", bars.cast("double")))
    return F.concat_ws(", ", text, F.concat(col(count).cast("string"), F.lit(" slices")), F.when(col(bpm) > 0, F.concat(half_up(bpm).cast("string"), F.lit(" BPM"))).otherwise(F.lit("no tempo")))


def level_span(level: str, count, slices_per_beat, slices_per_bar) -> Column:
    beat, bar = F.greatest(F.lit(1), col(slices_per_beat)), F.greatest(F.lit(1), col(slices_per_beat), col(slices_per_bar))
    half = lambda x: F.floor(x / 2).cast("int")  # noqa: E731  0 where it can't be halved
    return {"phrase": col(count), "bar": bar, "halfBar": half(bar), "beat": beat, "halfBeat": half(beat), "slice": F.lit(1), "micro": F.lit(1)}[level].cast("int")


def level_exists(level: str, count, slices_per_beat, slices_per_bar) -> Column:
    span = level_span(level, count, slices_per_beat, slices_per_bar)
    return F.lit(True) if level == "phrase" else (span >= 1) & (span * 2 <= col(count))


def hierarchy(slices: DataFrame, keys: list[str], levels: tuple[str, ...] = LEVELS) -> DataFrame:
    """Nodes of every level of files (count, per_beat, per_bar; rows of a slice map will do): arithmetic on one row a file, so nothing is shuffled."""
    files = (slices.where("slice = 0") if "slice" in slices.columns else slices).select(*keys, "count", "per_beat", "per_bar")
    spans = [F.struct(F.lit(level).alias("level"), level_span(level, "count", "per_beat", "per_bar").alias("span"), level_exists(level, "count", "per_beat", "per_bar").alias("exists")) for level in levels]
    nodes = files.select("*", F.explode(F.array(*spans)).alias("l")).where("l.exists and l.span > 0")
    nodes = nodes.select("*", F.explode(F.sequence(F.lit(0), F.ceil(F.col("count") / F.col("l.span")).cast("int") - 1)).alias("index"))
    nodes = nodes.withColumn("start", F.col("index") * F.col("l.span")).withColumn("end", F.least(F.col("start") + F.col("l.span"), "count"))
    in_bar = F.pmod("start", "per_bar")
    return nodes.select(
        *keys, "l.level", "index", "start", "end", ((F.col("end") % F.col("per_bar") == 0) | (F.col("end") >= F.col("count"))).alias("ends_bar"), (F.col("end") >= F.col("count")).alias("ends_phrase"),
        (in_bar == 0).alias("is_downbeat"), (in_bar % F.col("per_beat") == 0).alias("is_beat"), metric_strength("start", "per_beat", "per_bar").alias("strength"),
    )


def appeal(bias: dict[str, float], ends_bar, ends_phrase, downbeat, beat, position) -> Column:
    """Product of the factors of a bias that apply, 0.01 at least."""
    out = F.lit(1.0)
    for name, condition in (("endOfBar", col(ends_bar)), ("endOfPhrase", col(ends_phrase)), ("lastBar", col(position) >= 0.75), ("downbeat", col(downbeat)), ("offBeat", ~col(beat))):
        if bias.get(name):
            out = out * F.when(condition, bias[name]).otherwise(1.0)
    if bias.get("late"):
        out = out * (1 + (bias["late"] - 1) * col(position))
    return F.greatest(F.lit(0.01), out)
