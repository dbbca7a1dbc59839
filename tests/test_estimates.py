"""Key and tempo detection, file sinks, decoders, joins and small texts."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sonarframe.functions import music, tempo, udf
from sonarframe.kernels import analysis, estimate
from sonarframe.operators import matching, slices
from sonarframe.plans import conform, fx
from sonarframe.sources import codec, files
from test_kernels import RATE, beat


def chord_loop(root, mode, seconds=6.0):
    """Tonic, subdominant, dominant and tonic triads with overtones."""
    third = 4 if mode == "major" else 3
    t = np.arange(int(RATE * seconds / 4)) / RATE
    parts = []
    for step, quality in ((0, third), (5, third), (7, 4), (0, third)):
        x = np.zeros(len(t))
        for n in (root + step, root + step + quality, root + step + 7):
            for h in (1, 2, 3):
                x += np.sin(2 * np.pi * h * 261.63 * 2 ** (n / 12 - 1) * t) / h**1.5
        parts.append(x * np.exp(-t))
    return np.concatenate(parts).astype(np.float32)


@pytest.mark.parametrize("root", range(0, 12, 2))
@pytest.mark.parametrize("mode", ["major", "minor"])
def test_key(root, mode):
    assert estimate.key(chord_loop(root, mode), RATE)[:2] == (music.NOTES[root], mode)


@pytest.mark.parametrize("bpm", [84, 100, 123, 140])
def test_tempo(bpm):
    found = estimate.tempo(beat(bpm, 12), RATE)
    assert min(abs(found / bpm - f) for f in (0.5, 1, 2)) < 0.02


def test_nothing_to_detect():
    for x in (np.zeros(0), np.zeros(RATE), np.ones(10)):
        assert estimate.key_and_tempo(x, RATE)["bpm"] is None
    assert estimate.key(np.zeros(RATE), RATE) is None
    assert estimate.key_and_tempo(chord_loop(0, "major"), RATE, want_key=False)["key"] is None


def test_key_and_tempo_column(spark):
    rows = spark.createDataFrame([(1, chord_loop(9, "minor").tolist()), (2, None), (3, [])], "i int, x array<float>")
    got = {r.i: r.f for r in rows.select("i", udf.key_and_tempo(RATE)("x").alias("f")).collect()}
    assert (got[1].key, got[1].scale) == ("A", "minor") and (got[2] is None or got[2].key is None) and got[3].bpm is None


def test_opens_on_hit():
    x = np.concatenate([np.ones(2000), np.zeros(18000)]).astype(np.float32)
    level = analysis.envelope(x, RATE, 20, 10)[1]
    assert analysis.opens_on_hit(x, RATE, np.ones(10)) and not analysis.opens_on_hit(x[::-1], RATE, np.ones(10))
    assert not analysis.opens_on_hit(x[:4], RATE, level) and not analysis.opens_on_hit(x, RATE, np.zeros(0))


def test_loop_snap_against_candidates(spark):
    draw = np.random.default_rng(2)
    rows = [(float(d), float(b)) for d, b in zip(draw.uniform(0.2, 60, 3000), draw.uniform(30, 240, 3000))] + [(0.0, 120.0), (2.0, 120.0), (1.0, None), (1.5, 120.0), (1000.0, 300.0)]

    def near(x, options):
        return min(options, key=lambda c: (abs(c - x), options.index(c)), default=None)

    def want(d, b):
        if not d or not b or d * b / 60 < 0.5:
            return None
        beats = d * b / 60
        n = np.floor(beats + 0.5)
        evens = [n] if n % 2 == 0 else [c for c in (n - 1, n + 1) if c >= 1]
        for tier in ([float(1 << i) for i in range(11)], [float(w) for w in tempo.WHOLE_BARS], evens, [n]):
            c = near(beats, tier)
            if c is not None and c >= 1 and abs(c * 60 / d / b - 1) <= tempo.SNAP_DRIFT:
                return c
        return None

    got = spark.createDataFrame(rows, "d double, b double").select("d", "b", tempo.loop_snap("d", "b").alias("s")).collect()
    assert [r.s.beats if r.s else None for r in got] == [want(r.d, r.b) for r in got]


def test_texts(spark):
    rows = spark.createDataFrame([("half", 120.0, "1/2bar", "c#", "min", True), ("normal", 120.0, "1/16", None, None, True), ("double", None, "1/4", "H", "", False), ("x", 90.4, None, "Bb", "major", True)], "f string, b double, s string, k string, m string, p boolean")
    got = rows.select(tempo.format_feel("f", "b").alias("feel"), slices.chop_label("s").alias("chop"), music.resolve_key("k", "m").alias("key"), conform.format_target("b", "k", "m", "p").alias("target")).collect()
    assert [r.feel for r in got] == ["½ time · 60 BPM", None, "2× time", None]
    assert [r.chop for r in got] == ["½ bar", "1/16", "1/4", ""]
    assert [tuple(r.key) for r in got] == [("C#", "minor", True), (None, "minor", False), (None, "minor", False), ("A#", "major", True)]
    assert [r.target for r in got] == ["120 BPM / C# minor", "120 BPM", "no target yet", "90 BPM / A# major"]


def test_children_against_all_pairs(spark):
    draw = np.random.default_rng(3)
    make = lambda n, longest: [(int(draw.integers(3)), float(s), float(s + d)) for s, d in zip(draw.uniform(0, 50, n), draw.uniform(0.1, longest, n))]
    parents, nodes = make(40, 12), make(80, 3)
    got = matching.children(*(spark.createDataFrame(x, "k int, start double, end double") for x in (parents, nodes)), ["k"], 5.0).collect()
    want = sorted((k, a, b, s, e) for k, a, b in parents for j, s, e in nodes if k == j and s >= a and e <= b)
    assert sorted((r.k, r.p_start, r.p_end, r.start, r.end) for r in got) == want and want


def test_nearest_with_repeated_ids(spark):
    left = spark.createDataFrame([(1, "a", 1.0), (1, "a", 9.0), (1, "b", 1.0)], "i int, k string, t double")
    right = spark.createDataFrame([("a", 1.5), ("a", 8.0)], "k string, at double")
    got = matching.nearest(left, right, ["k"], "t", "at", 2.0, "i").collect()
    assert sorted((r.k, r.t, r.matched) for r in got if r.matched) == [("a", 1.0, 1.5), ("a", 9.0, 8.0)] and len(got) == 3


def test_files_are_written_and_removed(spark, tmp_path):
    rows = spark.createDataFrame([("chops/a", "1.wav", b"one"), ("chops/a", "2.wav", b"two"), ("", "x.txt", b"")], "directory string, name string, content binary")
    done = files.write(rows, f"file://{tmp_path}").collect()
    assert sorted(r.bytes for r in done) == [0, 3, 3] and (tmp_path / "chops/a/2.wav").read_bytes() == b"two"
    files.write(rows, str(tmp_path)).collect()  # again: the same files
    assert sorted(p.name for p in tmp_path.rglob("*") if p.is_file()) == ["1.wav", "2.wav", "x.txt"]
    gone = files.stale(rows, rows.where("directory = 'chops/a'")).select("directory", "name").union(spark.createDataFrame([("chops/a", "9.wav")]))
    assert sorted((r.path.rpartition("/")[2], r.removed) for r in files.remove(gone, str(tmp_path)).collect()) == [("1.wav", True), ("2.wav", True), ("9.wav", False)]
    assert [p.name for p in tmp_path.rglob("*") if p.is_file()] == ["x.txt"]


def test_registered_decoder(spark, monkeypatch):
    monkeypatch.setattr(codec, "DECODERS", {})
    rows = spark.createDataFrame([("a.raw", bytes(range(8))), ("b.mp3", b"12"), ("c.raw", b"")], "path string, content binary")

    def decode(raw):
        if not raw:
            raise ValueError("empty")
        return 8000, np.frombuffer(raw, dtype=np.uint8)[None, :] / 256

    codec.register_decoder("RAW", decode)
    got = {r.path: r for r in codec.decode(rows).collect()}
    assert got["a.raw"].sample_rate == 8000 and len(got["a.raw"].channels[0]) == 8
    assert "mp3" in got["b.mp3"].error and got["c.raw"].error == "empty"


def test_fragments_of_silence_and_one_hit():
    for x in (np.zeros(RATE, dtype=np.float32), np.zeros(100, dtype=np.float32), np.concatenate([np.ones(300), np.zeros(3000)]).astype(np.float32)):
        found = analysis.analyse_break(x, RATE, 120.0)
        pools = fx.pools(found, x, RATE)
        assert set(pools) == {"snare", "hit", *fx.UNITS}
        for recipe in fx.plan_bank(pools, found["grid"]["beat"], 4, 0.5):
            assert recipe["source"]["end"] > recipe["source"]["start"]


def test_fragments_by_definition():
    """Scores and notes of cells against their definition, cell by cell."""
    x = beat(120, 8, 0.0)
    found = analysis.analyse_break(x, RATE, 120.0)
    grid, pools = found["grid"], fx.pools(found, x, RATE)
    near = lambda t, r: min(((abs(o - t), o, s) for o, s in found["onsets"] if abs(o - t) <= r), default=None)
    rms = lambda v: float(np.sqrt(np.mean(np.square(v, dtype=np.float64)))) if len(v) else 0.0
    checked = 0
    for kind, rows in pools.items():
        assert [r["score"] for r in rows] == sorted((r["score"] for r in rows), reverse=True)
        for r in rows if kind in fx.UNITS else ():
            own = near(r["anchor"], fx.OWN_ONSET)
            assert r["start"] == pytest.approx(max(0.0, own[1] - fx.LEAD) if own else r["anchor"])
            part = x[int(r["start"] * RATE + 0.5) : int(r["end"] * RATE + 0.5)]
            k = len(part) // 3
            want = (0.6 + 0.6 * own[2] if own else 0.15) + min(0.5, 0.3 * rms(part) / rms(x)) + 0.35 * min(1, max(0, 1 - rms(part[len(part) - k :]) / (rms(part[:k]) or 1)))
            place = (r["anchor"] - grid["downbeat"]) / grid["bar"] % 1
            closing = (r["end"] - grid["downbeat"]) / grid["bar"] % 1
            ends = place + fx.UNITS[kind] / 4 >= 0.999
            want += (0.3 if kind == "1/16" else 0.5) if ends else 0.25 if place >= 0.749 else 0
            bar = int(np.floor((r["anchor"] - grid["downbeat"]) / grid["bar"] + 1e-6))
            want += 0.3 * (grid["bars"] >= 2 and bar == grid["bars"] - 1 and place >= 0.5)
            after = near(r["end"], fx.END_ONSET)
            want += 0.35 * bool(after and after[2] >= 0.5 and min(closing, 1 - closing) < 0.02)
            assert r["score"] == pytest.approx(want, abs=1e-6)
            assert (r["note"] == "bar end") == ends
            checked += 1
    assert checked > 10
