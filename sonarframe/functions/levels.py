"""Decibels, gains and simple shapes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sonarframe.functions.columns import col
from sonarframe.functions.numbers import clamp, half_up

#: Two floors are in use: analysis frames go down to -180 dB, loudness to -120 dB.
FRAME_FLOOR_DB, LOUDNESS_FLOOR_DB = -180.0, -120.0
REFERENCE_DB, GAIN_LIMIT_DB = -20.0, 12.0


def to_db(x, floor: float = FRAME_FLOOR_DB) -> Column:
    x = col(x).cast("double")
    return F.when(x > 1e-9, 20 * F.log10(x)).otherwise(F.lit(floor))


def from_db(db) -> Column:
    return F.pow(F.lit(10.0), col(db) / 20)


def match_gain(rms_db, reference: float = REFERENCE_DB) -> Column:
    """Linear gain to the reference loudness, at most 12 dB either way; 1 for a silent signal (null)."""
    return F.when(col(rms_db).isNull(), F.lit(1.0)).otherwise(from_db(clamp(F.lit(reference) - col(rms_db), -GAIN_LIMIT_DB, GAIN_LIMIT_DB)))


def format_level(rms_db, gain) -> Column:
    trim = 20 * F.log10(col(gain))
    sign = F.when(trim >= 0, F.lit("+")).otherwise(F.lit(""))
    return F.when(col(rms_db).isNull(), F.lit("silent")).otherwise(F.concat(F.format_string("%.1f dB, ", col(rms_db)), sign, F.format_string("%.1f dB", trim)))


def soft_saturate(x, drive=1.0) -> Column:
    return F.tanh(col(x) * col(drive)) / F.tanh(col(drive).cast("double"))


def soft_limit(x, ceiling: float = 0.98) -> Column:
    """Unchanged up to the ceiling; above it a tanh knee in what is left up to 1."""
    x, room = col(x), 1 - ceiling
    over = F.abs(x) - ceiling
    return F.when(F.abs(x) <= ceiling, x).otherwise(F.signum(x) * (ceiling + room * F.tanh(over / room)))


def quantise(x, bits: int) -> Column:
    """To steps of 2 / 2**bits."""
    step = 2.0 / (1 << bits)
    return half_up(col(x) / step) * step


def semitones_to_ratio(st) -> Column:
    return F.pow(F.lit(2.0), col(st) / 12)


def ratio_to_semitones(ratio) -> Column:
    return F.when(col(ratio) > 0, 12 * F.log2(col(ratio))).otherwise(F.lit(0.0))


def curve(low: float, high: float, t, exponential: bool = False) -> Column:
    """A control position 0..1 on a linear or exponential range."""
    t = clamp(t, 0.0, 1.0)
    return F.lit(low) * F.pow(F.lit(high / low), t) if exponential else low + (high - low) * t


def uncurve(low: float, high: float, value, exponential: bool = False) -> Column:
    value = col(value)
    t = F.ln(value / low) / F.ln(F.lit(high / low)) if exponential else (value - low) / (high - low)
    return clamp(t, 0.0, 1.0)


DRIVES = ("tape", "tube", "diode", "fuzz")


def drive(x, kind: str, amount_percent=0.0) -> Column:
    """Stateless wave shapers at gain 1 + 5 * amount, mixed in by the amount."""
    x, d = col(x), clamp(col(amount_percent) / 100, 0.0, 1.0)
    g = 1 + 5 * d
    if kind == "tube":  # a bias makes it softer on one side
        wet = F.tanh((x + 0.2 * d) * g) - F.tanh(0.2 * d * g)
    elif kind == "diode":
        wet = clamp(x * g, -1.0, 1.0)
    elif kind == "fuzz":
        wet = F.when(x > 0, F.tanh(3 * g * x)).otherwise(clamp(x * g, -1.0, 0.0))
    else:
        wet = F.tanh(x * g)
    return F.when(d <= 1e-4, x).otherwise((1 - d) * x + d * wet)


def crunch(samples, bits: int = 16, rate_divide: int = 1) -> Column:
    """Sample and hold over ``rate_divide`` samples of an array, then quantised; no change at 16 bits and 1."""
    x = col(samples)
    if rate_divide > 1:
        x = F.transform(x, lambda v, i: F.get(x, (i - i % rate_divide).cast("int")))
    return F.transform(x, lambda v: quantise(v, bits)) if bits < 16 else x


def rotate(samples, by) -> Column:
    """Circular shift to the left."""
    x = col(samples)
    n = F.size(x)
    k = F.when(n > 0, F.pmod(col(by).cast("int"), F.greatest(n, F.lit(1)))).otherwise(0)
    return F.concat(F.slice(x, k + 1, n), F.slice(x, F.lit(1), k))


def fades(samples, fade_in: int, fade_out: int) -> Column:
    """Linear fades, each over half of the signal at most; the first and the last sample become 0."""
    x = col(samples)
    n = F.size(x)
    half = F.floor(n / 2)
    fi, fo = F.least(F.lit(fade_in), half), F.least(F.lit(fade_out), half)
    up = lambda i: F.when(i < fi, i / F.greatest(fi, F.lit(1))).otherwise(F.lit(1.0))
    down = lambda i: F.when(n - 1 - i < fo, (n - 1 - i) / F.greatest(fo, F.lit(1))).otherwise(F.lit(1.0))
    return F.transform(x, lambda v, i: v * up(i) * down(i))


def resample_linear(samples, ratio) -> Column:
    """``round(n * ratio)`` samples by linear interpolation; the last sample is held."""
    x, r = col(samples), col(ratio).cast("double")
    n = F.size(x)
    out = F.greatest(F.lit(1), half_up(n * r)).cast("int")
    at = lambda i: i / r
    low = lambda i: F.least(n - 1, F.floor(at(i))).cast("int")
    share = lambda i: at(i) - F.floor(at(i))
    return F.transform(F.sequence(F.lit(0), out - 1), lambda i: F.get(x, low(i)) * (1 - share(i)) + F.get(x, F.least(n - 1, low(i) + 1).cast("int")) * share(i))


def to_mono(channels) -> Column:
    """Mean of channels (array of arrays)."""
    c = col(channels)
    n = F.size(c)
    total = F.aggregate(F.slice(c, F.lit(2), F.greatest(n - 1, F.lit(0))), F.get(c, F.lit(0)), lambda a, b: F.zip_with(a, b, lambda x, y: x + y))
    return F.when(n == 1, F.get(c, F.lit(0))).otherwise(F.transform(total, lambda v: v / n))
