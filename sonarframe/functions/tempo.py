"""Tempo: overrides, octaves, loop lengths, grids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sonarframe.functions.columns import col, let
from sonarframe.functions.numbers import clamp, half_up, positive_or_null

MOST_BPM = 100_000.0
SNAP_DRIFT = 0.025
#: How many times longer each feel is.
FEELS = {"quarter": 4.0, "half": 2.0, "normal": 1.0, "double": 0.5, "quadruple": 0.25}
WHOLE_BARS = (4, 8, 12, 16, 20, 24, 28, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 256)
FACTORS = (0.25, 0.5, 2 / 3, 1.0, 1.5, 2.0, 4.0)


def source_bpm(value) -> Column:
    bpm = positive_or_null(value)
    return F.when(bpm.isNotNull(), F.least(F.lit(MOST_BPM), bpm))  # least() alone would pass over a null


def target_bpm(value) -> Column:
    bpm = source_bpm(value)
    return F.when(bpm.isNotNull(), F.greatest(F.lit(1.0), bpm))


def effective(override, detected) -> Column:
    """An override beats detection; a detected 0 is none."""
    return F.coalesce(col(override), F.nullif(col(detected), F.lit(0)))


def ratio_for(detected, target) -> Column:
    """Length ratio that takes one tempo to another; 1 where either is missing."""
    ok = (col(detected) > 0) & (col(target) > 0)
    return F.when(ok, col(detected) / col(target)).otherwise(F.lit(1.0))


def feel_length(feel) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in FEELS.items() for x in kv)), col(feel)), F.lit(1.0))


def feel_target(bpm, feel) -> Column:
    return F.when(col(bpm) > 0, col(bpm) / feel_length(feel)).otherwise(col(bpm))


#: Labels of the feels other than the normal one.
FEEL_LABELS = {"quarter": "¼ time", "half": "½ time", "double": "2× time", "quadruple": "4× time"}


def format_feel(feel, bpm) -> Column:
    """The feel's label and the tempo that it makes of a target; null for the normal feel and unknown ones."""
    label = F.try_element_at(F.create_map(*(F.lit(x) for kv in FEEL_LABELS.items() for x in kv)), col(feel))
    made = feel_target(bpm, feel)
    return F.when(made > 0, F.concat(label, F.lit(" · "), half_up(made).cast("long").cast("string"), F.lit(" BPM"))).otherwise(label)


def bars_to_seconds(bars, bpm, beats_per_bar: int = 4) -> Column:
    return F.when((col(bpm) > 0) & (col(bars) > 0), col(bars) * beats_per_bar * (60 / F.nullif(col(bpm), F.lit(0))))


def drum_lengths(bars, bpm) -> Column:
    """struct(preferred, min_len, max_len) in seconds."""
    preferred = F.coalesce(bars_to_seconds(bars, bpm), col(bars).cast("double"))
    return F.struct(preferred.alias("preferred"), F.greatest(F.lit(0.4), preferred * 0.5).alias("min_len"), F.when(col(bpm) > 0, preferred * 1.5).otherwise(preferred * 2).alias("max_len"))


def better_octave(bpm, target) -> Column:
    """Half or double the tempo if that is nearer to the target by more than 0.15 octaves, else null."""
    bpm, target = positive_or_null(bpm), positive_or_null(target)
    far = lambda x: F.abs(F.log2(x / target))
    half, double = bpm / 2, bpm * 2
    half_wins = far(half) < far(bpm) - 0.15
    best = F.when(half_wins, far(half)).otherwise(far(bpm))
    return F.when(far(double) < best - 0.15, double).when(half_wins, half)


def _step_to(x: Column, bounds: tuple[tuple[float, float], ...], last: float) -> Column:
    """The value of the first bound that ``x`` doesn't exceed, else ``last``."""
    out = F.when(x <= bounds[0][0], bounds[0][1])
    for bound, value in bounds[1:]:
        out = out.when(x <= bound, value)
    return out.otherwise(last)


def loop_snap(duration, bpm) -> Column:
    """struct(bpm, beats): the tempo at which a loop lasts a musical number of beats, if that is within 2.5 %.

    Tried in turn: powers of two, whole bars, the even numbers next to it, the nearest
    number.  Of equally near ones the lesser is taken.
    """

    def snap(given: Column) -> Column:
        beats = given["duration"] * given["bpm"] / 60
        near = half_up(beats)
        octave = F.greatest(F.lit(0.0), F.least(F.lit(9.0), F.floor(F.log2(F.greatest(beats, F.lit(1.0))))))
        low = F.pow(F.lit(2.0), octave)
        power = F.when(beats - low <= 2 * low - beats, low).otherwise(2 * low)
        whole = _step_to(beats, tuple(((a + b) / 2, float(a)) for a, b in zip(WHOLE_BARS, WHOLE_BARS[1:])), float(WHOLE_BARS[-1]))
        odd = near % 2 == 1
        even = F.when(~odd, near).when((beats - (near - 1) <= near + 1 - beats) & (near > 1), near - 1).otherwise(near + 1)
        out = []
        for best in (power, whole, even, near):
            best = best.cast("double")
            snapped = best * 60 / given["duration"]
            out.append(F.when((best >= 1) & (F.abs(snapped / given["bpm"] - 1) <= SNAP_DRIFT), F.struct(snapped.alias("bpm"), best.alias("beats"))))
        return F.when(beats >= 0.5, F.coalesce(*out))

    return let(F.struct(positive_or_null(duration).alias("duration"), positive_or_null(bpm).alias("bpm")), snap)


def interpretations(bpm, low: int = 30, high: int = 300) -> Column:
    """Rounded readings of a tempo in range, sorted and distinct; the tempo itself always stays."""
    bpm = positive_or_null(bpm)
    every = F.transform(F.array(*map(F.lit, FACTORS)), lambda f: half_up(bpm * f).cast("int"))
    kept = F.filter(every, lambda v: v.between(low, high) | (v == half_up(bpm)))
    return F.when(bpm.isNull(), F.array().cast("array<int>")).otherwise(F.array_sort(F.array_distinct(kept)))


def snap_to_grid(t, period, start=0.0, tolerance=None) -> Column:
    """The nearest grid line within the tolerance, else ``t``."""
    t, period, start = col(t), col(period), col(start)
    line = start + half_up((t - start) / period) * period
    return F.when(period > 0, line if tolerance is None else F.when(F.abs(line - t) <= col(tolerance), line).otherwise(t)).otherwise(t)


def grid_line(t, period, start=0.0, direction: int = 0) -> Column:
    """The nearest line (0), the next one after (1) or the last one before (-1)."""
    n = (col(t) - col(start)) / col(period)
    k = half_up(n) if direction == 0 else F.floor(n + 1e-9) + 1 if direction > 0 else F.ceil(n - 1e-9) - 1
    return col(start) + k * col(period)


def grid_position(t, bpm, downbeat=0.0) -> Column:
    """struct(bar, beat, sixteenth), counted from 1, as (t - downbeat) falls."""
    sixteenths = F.floor((col(t) - col(downbeat)) * col(bpm) / 60 * 4 + 1e-6).cast("long")
    return F.struct((F.floor(sixteenths / 16) + 1).alias("bar"), (F.floor(F.pmod(sixteenths, F.lit(16)) / 4) + 1).alias("beat"), (F.pmod(sixteenths, F.lit(4)) + 1).alias("sixteenth"))


def format_ratio(ratio) -> Column:
    return F.concat(F.format_string("%.3f", col(ratio).cast("double")), F.lit("x"))


def format_tempo_change(ratio) -> Column:
    r = col(ratio).cast("double")
    pct = (1 / F.nullif(r, F.lit(0.0)) - 1) * 100
    text = F.concat(F.when(pct > 0, "+").otherwise(""), F.format_string("%.1f", pct), F.when(pct > 0, F.lit("% faster")).otherwise(F.lit("% slower")))
    return F.when(r.isNull() | F.isnan(r) | (F.abs(r - 1) < 1e-6), F.lit("no change")).otherwise(text)


def map_position(position, from_duration, to_duration) -> Column:
    ok = (col(from_duration) > 0) & (col(to_duration) > 0)
    return F.when(ok, clamp(col(position) / F.nullif(col(from_duration), F.lit(0)), 0.0, 1.0) * col(to_duration)).otherwise(F.lit(0.0))


RATIO_PERCENT, SLIDER_STEPS = (5.0, 100_000.0), 1000


def tidy_percent(pct) -> Column:
    """Rounded to 1, 10 or 100 by size."""
    step = F.when(col(pct) < 1000, 1.0).when(col(pct) < 10_000, 10.0).otherwise(100.0)
    return half_up(col(pct) / step) * step


def slider_to_percent(position) -> Column:
    low, high = RATIO_PERCENT
    return tidy_percent(low * F.pow(F.lit(high / low), clamp(col(position) / SLIDER_STEPS, 0.0, 1.0)))


def percent_to_slider(pct) -> Column:
    low, high = RATIO_PERCENT
    return half_up(F.ln(clamp(pct, low, high) / low) / F.ln(F.lit(high / low)) * SLIDER_STEPS)
