"""Leaders and cuts are those of a loop over sorted rows."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sonarframe.kernels import analysis
from sonarframe.operators import selection


def loop(vectors, near):
    found, out = [], []
    for i, v in enumerate(vectors):
        first = next((j for j in found if 1 - float(np.dot(vectors[j], v)) <= near), None)
        if first is None:
            found.append(i)
        out.append(i if first is None else first)
    return out


def crowd(draw, n, dim, centres, spread):
    points = draw.normal(size=(centres, dim))
    v = points[draw.integers(0, centres, n)] + draw.normal(size=(n, dim)) * spread
    return v / np.linalg.norm(v, axis=1)[:, None]


@pytest.mark.parametrize("dim,centres,spread,axes", [(5, 6, 0.15, 3), (5, 1, 0.02, 5), (12, 10, 0.2, 2), (2, 9, 0.5, 3)])
def test_leaders(spark, dim, centres, spread, axes):
    draw = np.random.default_rng(dim + centres)
    v = crowd(draw, 260, dim, centres, spread)
    v[40:60] = v[7]  # copies
    rows = [("hot", i, x.tolist()) for i, x in enumerate(v)] + [(None, i, x.tolist()) for i, x in enumerate(v[:15])] + [("odd", 1, [0.0] * dim), ("odd", 2, None), ("odd", 3, v[0].tolist()), ("odd", 4, v[0].tolist())]
    frame = spark.createDataFrame(rows, "k string, i int, v array<double>").repartition(5)
    got = selection.leaders(frame, ["k"], "i", "v", 0.06, axes)
    found = {(r.k, r.i): r.leader for r in got.collect()}
    assert len(found) == len(rows)
    assert [found["hot", i] for i in range(260)] == loop(v, 0.06)
    assert [found[None, i] for i in range(15)] == loop(v[:15], 0.06)
    assert [found["odd", i] for i in (1, 2, 3, 4)] == [1, 2, 3, 3]


def test_leaders_of_many_blocks(spark, monkeypatch):
    """A chain of vectors that each wait for the one before takes as many rounds as it has blocks, not links."""
    written = []
    monkeypatch.setattr(selection, "BLOCK", 64)
    monkeypatch.setattr(selection, "table", lambda df, name, table=selection.table: written.append(name) or table(df, name))
    turn = np.arange(200) * 0.2
    v = np.stack([np.cos(turn), np.sin(turn)], axis=1) @ np.linalg.qr(np.random.default_rng(5).normal(size=(64, 2)))[0].T
    v[150:170] = v[3]
    frame = spark.createDataFrame([(k, i, x.tolist()) for k in (1, None) for i, x in enumerate(v)], "k int, i int, v array<double>").repartition(5)
    found = {(r.k, r.i): r.leader for r in selection.leaders(frame, ["k"], "i", "v", 0.06).collect()}
    for k in (1, None):
        assert [found[k, i] for i in range(200)] == loop(v, 0.06)
    assert written.count("decided") == 4 and len(written) < 10


def test_pairs_on_the_edge_are_added_in_order():
    draw = np.random.default_rng(9)
    a, b = draw.normal(size=(70, 64)), draw.normal(size=(60, 64))
    for i, j in ((0, 0), (69, 59), (33, 7)):
        dot = 0.0
        for x, y in zip(a[i], b[j]):
            dot += x * y
        assert selection._close(a, b, 1 - dot)[i, j] and not selection._close(a, b, np.nextafter(1 - dot, -100))[i, j]


def test_dedupe_is_the_loop_of_the_kernel(spark):
    draw = np.random.default_rng(3)
    v = crowd(draw, 150, 5, 40, 0.3)
    hits = [{"start": float(i), "peak": float(round(draw.uniform(0, 1), 2)), "fingerprint": x.tolist(), "k": 1} for i, x in enumerate(v)]
    got = selection.dedupe(spark.createDataFrame([(h["k"], h["start"], h["peak"], h["fingerprint"]) for h in hits], "k int, start double, peak double, fingerprint array<double>").repartition(4), ["k"], "start", "fingerprint", "peak")
    assert sorted((r.start, r.peak) for r in got.collect()) == sorted((h["start"], h["peak"]) for h in analysis.dedupe_hits(hits))
    assert selection.dedupe(spark.createDataFrame([], "k int, start double, peak double, fingerprint array<double>"), ["k"], "start", "fingerprint", "peak").count() == 0


def test_spaced_takes_the_best_first(spark):
    draw = random.Random(5)
    rows = [("a", float(t), float(draw.randrange(12))) for t in draw.sample(range(600), 260)] + [(None, float(t), 1.0) for t in range(40)] + [("slope", float(t), float(t)) for t in range(30)]
    got = selection.spaced(spark.createDataFrame(rows, "k string, t double, s double").repartition(4), ["k"], "t", "s", 7.0)
    want = []
    for k in ("a", None, "slope"):
        taken = []
        for t, s in sorted(((t, s) for x, t, s in rows if x == k), key=lambda r: (-r[1], r[0])):
            if all(abs(t - u) >= 7 for u in taken):
                taken.append(t)
        want += [(k or "", t) for t in taken]
    assert sorted((r.k or "", r.t) for r in got.collect()) == sorted(want)


def test_boundary_scores(spark):
    draw = random.Random(6)
    db = [draw.choice([-180.0, -60.0, -30.0, -25.0, -12.0, -10.0, -8.0]) for _ in range(160)]
    onsets = {t: draw.random() for t in sorted(draw.sample(range(160), 40)) + [0]}
    frames = spark.createDataFrame([(1, i, v) for i, v in enumerate(db)], "k int, i int, db double").repartition(3)
    given = spark.createDataFrame([(1, t, s) for t, s in onsets.items()], "k int, i int, s double")
    got = {r.i: r.score for r in selection.boundary_scores(frames, given, ["k"], "i", "db", "s", back=9, deep=12.0, long=4, reference=25).collect()}
    ref = []
    for i in range(160):
        part = [v for v in db[max(0, i - 24) : i + 1] if v > -180]
        ref.append(sum(part) / len(part) if part else -180.0)
    typical = sorted(onsets.values())[math.floor((len(onsets) - 1) * 0.75)]
    for t, s in onsets.items():
        low, run, longest = None, 0, 0
        for k in range(max(0, t - 9), t):
            low = db[k] if low is None else min(low, db[k])
            run = run + 1 if db[k] <= ref[k] - 12 else 0
            longest = max(longest, run)
        want = 0.0 if low is None else max(0.0, ref[t] - low) / 12 + min(2, s / typical) + longest / 4
        assert got[t] == pytest.approx(want, abs=1e-9), t


def test_long_pieces_are_cut(spark):
    draw = random.Random(7)
    candidates = [("a", float(t), draw.random()) for t in draw.sample(range(0, 700), 30)]
    frames = [("a", float(t), draw.random()) for t in range(0, 1500)]
    pieces = [("a", 0.0, 800.0), ("a", 800.0, 820.0), ("a", 820.0, 1400.0), ("b", 0.0, 130.0)]
    got = selection.cut_long(spark.createDataFrame(pieces, "k string, start double, end double"), spark.createDataFrame(candidates, "k string, t double, s double"), spark.createDataFrame(frames, "k string, t double, v double"), ["k"], "t", "s", "v", 10.0, 60.0, 40.0)
    found = sorted((r.k, r.start, r.end) for r in got.collect())
    ends = []
    for k, a, z in pieces:
        marks, i = [a, z], 0
        while i < len(marks) - 1:
            length = marks[i + 1] - marks[i]
            if length <= 60:
                i += 1
                continue
            target, low, high = marks[i] + min(40, length / 2), marks[i] + 10, marks[i + 1] - 10
            own = sorted(((s - abs(t - target) / 60, -t) for x, t, s in candidates if x == k and low <= t <= high), reverse=True)
            quiet = sorted((v, t) for x, t, v in frames if x == k and low <= t <= high)
            marks.insert(i + 1, -own[0][1] if own else quiet[0][1] if quiet else target)
        ends += [(k, s, e) for s, e in zip(marks, marks[1:])]
    assert found == sorted(ends)
    assert selection.cut_long(spark.createDataFrame(pieces[1:2], "k string, start double, end double"), spark.createDataFrame(candidates, "k string, t double, s double"), spark.createDataFrame(frames, "k string, t double, v double"), ["k"], "t", "s", "v", 10.0, 60.0, 40.0).count() == 1
