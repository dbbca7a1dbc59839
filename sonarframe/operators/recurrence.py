"""Linear recurrences along an order: filters, leaky means, decaying peaks.

A step of y[n] = sum(b[i] x[n-i]) - sum(a[i] y[n-1-i]) is an affine map of a state as
long as ``a``.  A chunk of steps is one affine map too, a power of one matrix and the
response from rest, so chunks are summed up apart, their maps are carried on, and each is
worked out from the state that reaches it (``chunks``).  Inside a chunk steps are composed by
doubling; nowhere does a loop pass samples one by one.  A null value counts as 0.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sonarframe.operators.chunks import CHUNK, carried, numbered

Coefficients = tuple[tuple[float, ...], tuple[float, ...]]


def _states(x: np.ndarray, matrix: np.ndarray, gain: np.ndarray, start: np.ndarray | None = None) -> np.ndarray:
    """The state after each step, from ``start`` or from rest."""
    states = x[:, None] * gain[None, :]
    if start is not None and len(x):
        states[0] += matrix @ start
    step, power = 1, matrix
    while step < len(x):
        states[step:] += states[:-step] @ power.T
        step, power = 2 * step, power @ power
    return states


def difference(rows: DataFrame, keys: list[str], order: list[str], value: str, b: Sequence[float], a: Sequence[float], out: str = "y", chunk: int = CHUNK) -> DataFrame:
    """``rows`` with y[n] = sum(b[i] x[n-i]) - sum(a[i] y[n-1-i]) along ``order`` for each key, from rest.  ``a`` has one value at least."""
    a, b = np.array(a, dtype=float), np.array([*b, *[0.0] * (len(a) + 1 - len(b))], dtype=float)
    d = len(a)
    if not d or len(b) != d + 1:
        raise ValueError("a has a value at least, and b one more at most")
    matrix = np.eye(d, k=1)  # transposed direct form
    matrix[:, 0] -= a
    gain = b[1:] - a * b[0]
    placed = numbered(rows.withColumn("__x", F.coalesce(F.col(value).cast("double"), F.lit(0.0))), keys, order, chunk)

    def summarise(rows: pa.Table) -> dict[str, pa.Array]:
        x = rows["__x"].to_numpy()
        return {"steps": pa.array([len(x)], pa.int64()), "response": pa.array([_states(x, matrix, gain)[-1]], pa.list_(pa.float64()))}

    def combine(rows: pa.Table) -> dict[str, pa.Array]:
        state, out, powers = np.zeros(d), [], {}
        for n, response in zip(rows["steps"].to_pylist(), rows["response"].to_pylist()):
            out.append(state)
            if n not in powers:
                powers[n] = np.linalg.matrix_power(matrix, n)
            state = powers[n] @ state + response
        return {"state": pa.array(out, pa.list_(pa.float64()))}

    def apply(rows: pa.Table) -> dict[str, pa.Array]:
        x, start = rows["__x"].to_numpy(), np.array(rows["state"][0].as_py())
        before = np.concatenate([[start[0]], _states(x, matrix, gain, start)[:-1, 0]])
        return {"__y": pa.array(b[0] * x + before)}

    found = carried(placed, keys, summarise, "steps long, response array<double>", combine, "state array<double>", apply, "__y double")
    return found.select(*rows.columns, F.col("__y").alias(out))


def peak_hold(rows: DataFrame, keys: list[str], order: list[str], value: str, decay: float, out: str = "peak", chunk: int = CHUNK) -> DataFrame:
    """``rows`` with max(value, decay * the peak before) along ``order``, from 0."""
    if not 0 <= decay <= 1:
        raise ValueError("a decay lies between 0 and 1")
    placed = numbered(rows.withColumn("__x", F.coalesce(F.col(value).cast("double"), F.lit(0.0))), keys, order, chunk)

    def held(x: np.ndarray, start: float) -> np.ndarray:
        peak, step, factor = x.copy(), 1, decay
        if len(x):
            peak[0] = max(peak[0], start * decay)
        while step < len(x):
            peak[step:] = np.maximum(peak[step:], peak[:-step] * factor)
            step, factor = 2 * step, factor * factor
        return peak

    def summarise(rows: pa.Table) -> dict[str, pa.Array]:
        x = rows["__x"].to_numpy()
        return {"steps": pa.array([len(x)], pa.int64()), "peak": pa.array([held(x, 0.0)[-1]])}

    def combine(rows: pa.Table) -> dict[str, pa.Array]:
        peak, out = 0.0, []
        for n, own in zip(rows["steps"].to_pylist(), rows["peak"].to_pylist()):
            out.append(peak)
            peak = max(own, peak * decay**n)
        return {"before": pa.array(out, pa.float64())}

    def apply(rows: pa.Table) -> dict[str, pa.Array]:
        return {"__y": pa.array(held(rows["__x"].to_numpy(), rows["before"][0].as_py()))}

    found = carried(placed, keys, summarise, "steps long, peak double", combine, "before double", apply, "__y double")
    return found.select(*rows.columns, F.col("__y").alias(out))


def low_pass(cutoff: float, rate: float) -> Coefficients:
    """One pole as an RC circuit: dt / (rc + dt)."""
    k = 1 / (1 + rate / (2 * math.pi * cutoff))
    return (k,), (k - 1,)


def high_pass(cutoff: float, rate: float) -> Coefficients:
    """What ``low_pass`` leaves."""
    (k,), a = low_pass(cutoff, rate)
    return (1 - k, k - 1), a


def smoother(cutoff: float, rate: float) -> Coefficients:
    """One pole with the exponential coefficient."""
    k = 1 - math.exp(-2 * math.pi * cutoff / rate)
    return (k,), (k - 1,)


def dc_block(r: float = 0.995) -> Coefficients:
    return (1.0, -1.0), (-r,)


def peak_eq(rate: float, freq: float, q: float, gain_db: float) -> Coefficients:
    """Peaking filter by the audio-EQ cookbook (R. Bristow-Johnson)."""
    w, g = 2 * math.pi * freq / rate, 10 ** (gain_db / 40)
    alpha, c = math.sin(w) / (2 * q), -2 * math.cos(w)
    a0 = 1 + alpha / g
    return ((1 + alpha * g) / a0, c / a0, (1 - alpha * g) / a0), (c / a0, (1 - alpha / g) / a0)


def low_shelf(rate: float, freq: float, gain_db: float, slope: float = 1.0) -> Coefficients:
    """Low shelf by the same cookbook."""
    w, g = 2 * math.pi * freq / rate, 10 ** (gain_db / 40)
    c, s = math.cos(w), math.sin(w) * math.sqrt((g + 1 / g) * (1 / slope - 1) + 2) * math.sqrt(g)
    up, down = g + 1, g - 1
    a0 = up + down * c + s
    return (g * (up - down * c + s) / a0, 2 * g * (down - up * c) / a0, g * (up - down * c - s) / a0), (-2 * (down + up * c) / a0, (up + down * c - s) / a0)
