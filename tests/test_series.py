"""Recurrences and spectra against plain loops and numpy."""

import numpy as np
import pytest

from sonarframe.kernels import filters
from sonarframe.operators import recurrence, spectrum

CASES = {
    "low": (recurrence.low_pass(300, 8000), lambda x: filters.one_pole(x, 300, 8000)),
    "high": (recurrence.high_pass(300, 8000), lambda x: filters.one_pole_high(x, 300, 8000)),
    "smooth": (recurrence.smoother(300, 8000), lambda x: filters.smooth(x, 300, 8000)),
    "dc": (recurrence.dc_block(), filters.dc_block),
    "peak": (recurrence.peak_eq(8000, 900, 0.8, 5), lambda x: filters.peak_eq(x, 8000, 900, 0.8, 5)),
    "shelf": (recurrence.low_shelf(8000, 200, -4), lambda x: filters.low_shelf(x, 8000, 200, -4)),
}


def loop(x, b, a):
    y = []
    for n in range(len(x)):
        y.append(sum(v * x[n - i] for i, v in enumerate(b) if n >= i) - sum(v * y[n - 1 - i] for i, v in enumerate(a) if n > i))
    return np.array(y)


@pytest.mark.parametrize("name", sorted(CASES))
def test_filters(spark, name):
    (b, a), kernel = CASES[name]
    x = np.random.default_rng(4).uniform(-1, 1, 3000)
    rows = [("hot", i, float(v)) for i, v in enumerate(x)] + [(None, 5, 1.0), (None, 7, None), ("short", -3, 2.0)]
    frame = spark.createDataFrame(rows, "k string, i int, v double").repartition(6)
    got = recurrence.difference(frame, ["k"], ["i"], "v", b, a, chunk=64)
    assert got.columns == ["k", "i", "v", "y"]
    found = sorted(got.collect(), key=lambda r: (r.k or "", r.i))
    assert np.allclose([r.y for r in found if r.k == "hot"], loop(x, b, a), atol=1e-9)
    assert np.allclose([r.y for r in found if r.k == "hot"], kernel(x), atol=1e-5)
    assert np.allclose([r.y for r in found if r.k is None], loop([1.0, 0.0], b, a)) and np.isclose([r.y for r in found if r.k == "short"], 2 * b[0])
    one = recurrence.difference(frame.where("k = 'hot'"), [], ["i"], "v", b, a).orderBy("i").collect()
    assert np.allclose([r.y for r in one], loop(x, b, a), atol=1e-9)


def test_peak_hold(spark):
    x = np.random.default_rng(5).uniform(0, 1, 500) ** 9
    frame = spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "i int, v double").repartition(3)
    got = recurrence.peak_hold(frame, [], ["i"], "v", 0.97, chunk=16).orderBy("i").collect()
    want, held = [], 0.0
    for v in x:
        held = max(v, held * 0.97)
        want.append(held)
    assert np.allclose([r.peak for r in got], want)


def test_spectra(spark):
    draw = np.random.default_rng(6)
    x = draw.normal(size=400)
    frame = spark.createDataFrame([("a", i, float(v)) for i, v in enumerate(x)] + [("gap", i, 1.0) for i in range(90) if i != 40], "k string, i int, v double").repartition(5)
    frames = spectrum.framed(frame, ["k"], "i", "v", 32, 12)
    got = spectrum.powers(frames, "samples", 32).select("k", "frame", "samples", "powers", spectrum.flatness("powers").alias("flat"), spectrum.band_shares("powers", [0, 4, 17]).alias("shares")).collect()
    assert sorted(r.frame for r in got if r.k == "a") == list(range((400 - 32) // 12 + 1))
    assert sorted(r.frame for r in got if r.k == "gap") == [0, 4]
    for r in got:
        if r.k == "a":
            part = x[r.frame * 12 : r.frame * 12 + 32]
            p = np.abs(np.fft.rfft(part)) ** 2
            assert np.allclose(r.samples, part) and np.allclose(r.powers, p, atol=1e-9)
            assert np.isclose(r.flat, np.exp(np.log(p + 1e-12).mean()) / (p + 1e-12).mean()) and np.allclose(r.shares, [p[:4].sum() / p.sum(), p[4:].sum() / p.sum()])
    means = spectrum.mean_flatness(spectrum.powers(frames, "samples", 32), ["k"], "powers", "samples").collect()
    assert np.isclose(next(r.flatness for r in means if r.k == "a"), np.mean([r.flat for r in got if r.k == "a"]))
    hann = frames.where("k = 'a' and frame = 0").select(spectrum.hann("samples", 32).alias("h")).first().h
    assert np.allclose(hann, x[:32] * np.hanning(32))
    with pytest.raises(ValueError):
        spectrum.powers(frames, "samples", 5000)
