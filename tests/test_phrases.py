"""Phrases from tables of frames against one pass over a list."""

import math
import random

from sonarframe.operators import phrases

LIMITS = dict(rest=4, shortest=6.0, longest=60.0, preferred=40.0, spacing=8.0, back=6, deep=12.0, long=3, reference=20)


def one_pass(db, onsets, rest, shortest, longest, preferred, spacing, back, deep, long, reference, boundary=2.5):
    loud = sorted(v for v in db if v > -180)
    gate = loud[math.floor((len(loud) - 1) * 0.9)] - 26
    inside, runs, start, quiet = [v >= gate for v in db], [], None, None
    for i, x in enumerate(inside):
        if x:
            if start is None:
                start = i
            elif quiet is not None and i - quiet >= rest:
                runs.append((start, quiet))
                start = i
            quiet = None
        elif quiet is None:
            quiet = i
    if start is not None:
        runs.append((start, quiet if quiet is not None else len(db)))
    typical = sorted(onsets.values())[math.floor((len(onsets) - 1) * 0.75)]
    ref = []
    for i in range(len(db)):
        part = [v for v in db[max(0, i - reference + 1) : i + 1] if v > -180]
        ref.append(sum(part) / len(part) if part else -180.0)

    def score(t):
        low, run, longest_run = None, 0, 0
        for k in range(max(0, t - back), t):
            low = db[k] if low is None else min(low, db[k])
            run = run + 1 if db[k] <= ref[k] - deep else 0
            longest_run = max(longest_run, run)
        return 0.0 if low is None else max(0.0, ref[t] - low) / deep + min(2, onsets[t] / typical) + longest_run / long

    out = []
    for a, z in runs:
        if z - a < shortest * 1.5:
            out.append((a, z))
            continue
        cuts = []
        for s, t in sorted(((score(t), t) for t in onsets if a + spacing < t < z - spacing), key=lambda c: (-c[0], c[1])):
            if s >= boundary and all(abs(t - c) >= spacing for c in cuts):
                cuts.append(t)
        marks, i = [a, *sorted(cuts), z], 0
        while i < len(marks) - 1:
            length = marks[i + 1] - marks[i]
            if length <= longest:
                i += 1
                continue
            target, low, high = marks[i] + min(preferred, length / 2), marks[i] + shortest, marks[i + 1] - shortest
            own = sorted((-(score(t) - abs(t - target) / longest), t) for t in onsets if low <= t <= high)
            quiet_at = sorted((v, t) for t, v in enumerate(db) if low <= t <= high)
            marks.insert(i + 1, own[0][1] if own else quiet_at[0][1])
        out += list(zip(marks, marks[1:]))
    return sorted(out)


def test_phrases(spark):
    files = {}
    for k in range(6):
        draw = random.Random(k)
        db, level = [], -12.0
        for i in range(700):
            if draw.random() < 0.03:
                level = draw.choice([-10.0, -14.0, -20.0, -60.0, -180.0])
            db.append(max(-180.0, level + round(draw.uniform(-3, 3), 3)) if level > -180 else -180.0)
        files[f"k{k}" if k else None] = (db, {t: round(draw.random(), 4) for t in sorted(draw.sample(range(700), 12 if k == 1 else 90))})
    frames = spark.createDataFrame([(k, i, v) for k, (db, _) in files.items() for i, v in enumerate(db)], "k string, i int, db double").repartition(5)
    onsets = spark.createDataFrame([(k, t, s) for k, (_, on) in files.items() for t, s in on.items()], "k string, i int, s double")
    got = {}
    for r in phrases.regions(frames, onsets, ["k"], "i", "db", "s", **LIMITS).collect():
        got.setdefault(r.k, []).append((r.start, r.end))
    for k, (db, on) in files.items():
        assert sorted(got[k]) == one_pass(db, on, **LIMITS), k
