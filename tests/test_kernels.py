import numpy as np
import pytest

from sonarframe.kernels import analysis, filters, primitives, rng, stages, stretch
from sonarframe.plans import fx, remix, sequential
from sonarframe.sources import codec

RATE = 22050


def tone(seconds=1.0, freq=220.0, seed=0):
    t = np.arange(int(RATE * seconds)) / RATE
    return (0.5 * np.sin(2 * np.pi * freq * t) + 0.02 * np.random.default_rng(seed).standard_normal(len(t))).astype(np.float32)


def beat(bpm, seconds, phase=0.1, seed=1):
    draw, x, n = np.random.default_rng(seed), np.zeros(int(RATE * seconds)), int(0.12 * RATE)
    e = np.exp(-np.arange(n) / (0.03 * RATE))
    for i in range(int((seconds - 0.2 - phase) / (30 / bpm)) + 1):
        a = int((phase + i * 30 / bpm) * RATE)
        if i % 2 == 0:
            x[a : a + n] += np.sin(2 * np.pi * 60 * np.arange(n) / RATE) * e * 0.9 if i // 2 % 2 == 0 else draw.standard_normal(n) * e * 0.5
        x[a : a + n] += np.diff(draw.standard_normal(n + 1)) * e * 0.1
    return x.astype(np.float32)


@pytest.mark.parametrize("key", sorted(stretch.CHARACTERS))
@pytest.mark.parametrize("ratio", [0.6, 1.7])
def test_characters(key, ratio):
    x = [tone(2.0), tone(2.0, 330.0)]  # longer than the largest frame
    y = stretch.stretch(x, RATE, ratio, key, seed=3)
    again = stretch.stretch(x, RATE, ratio, key, seed=3)
    assert len(y) == 2
    for a, b in zip(y, again):
        assert np.isfinite(a).all() and np.abs(a).max() <= 4 and np.abs(a).max() > 0.02
        assert abs(len(a) / (len(x[0]) * ratio) - 1) < 0.16
        assert np.array_equal(a, b)


def test_ratio_one_copies():
    x = tone(0.1)
    assert np.array_equal(stretch.stretch([x], RATE, 1.0)[0], x)
    assert stretch.stretch([np.zeros(0)], RATE, 2.0)[0].size == 0


def test_pitch_shift_keeps_length_and_moves_pitch():
    y = stretch.pitch_shift([tone()], RATE, 12, "clean")[0]
    spectrum = np.abs(np.fft.rfft(y * np.hanning(len(y))))
    assert len(y) == RATE and abs(np.argmax(spectrum) - 440) < 12


@pytest.mark.parametrize("mode", sorted(stages.STAGES))
def test_stages(mode):
    x = [tone(0.5), tone(0.5, 330.0)]
    y = stages.output_stage(x, RATE, mode, 100, 100, 7)
    assert all(np.isfinite(c).all() and len(c) == len(x[0]) and np.abs(c).max() < 4 for c in y)
    assert np.array_equal(stages.output_stage(x, RATE, mode, 0)[0], x[0])


@pytest.mark.parametrize("key", primitives.keys())
def test_primitives(key):
    p = primitives.get(key)
    y = p.run([tone(0.2), tone(0.2, 330.0)], RATE, {s.key: s.default for s in p.params})
    assert all(np.isfinite(c).all() and len(c) == int(RATE * 0.2) for c in y)


def test_graphs_are_seeded():
    assert primitives.build_graph(5) == primitives.build_graph(5) != primitives.build_graph(6)
    assert primitives.mutate_graph(primitives.build_graph(5), 9) != primitives.build_graph(5)
    with pytest.raises(KeyError):
        primitives.get("nope")


def test_filters_match_recurrence():
    x, k = tone(0.02), (1 / RATE) / (1 / (2 * np.pi * 150) + 1 / RATE)
    y, out = 0.0, []
    for v in x:
        y += k * (v - y)
        out.append(y)
    assert np.allclose(filters.one_pole(x, 150, RATE), out, atol=1e-6)
    p, want = 1e-6, []
    for v in np.abs(x):
        p = max(v, p * 0.99)
        want.append(p)
    assert np.allclose(filters.decay_peak(np.abs(x), 0.99), want)


def test_rng():
    a, b = rng.Rng(7), rng.Rng(7)
    assert [a.next() for _ in range(5)] == [b.next() for _ in range(5)]
    assert rng.hash_seed(0) == 1 and rng.hash_seed(2**32) == 1
    assert sorted(rng.Rng(3).shuffle(list(range(20)))) == list(range(20))


def test_grid_and_phrases():
    g = analysis.fit_grid(beat(123, 60), RATE, 123.046875)
    assert abs(60 / g["bpm"] * 123 - 60) < 0.003
    z = lambda s: np.zeros(int(s * RATE))
    x = np.concatenate([tone(2, 440), z(0.6), tone(3, 500), z(0.8), tone(1.5, 460)])
    assert len(analysis.phrase_regions(x, RATE, {"shortest": 1.0})) == 3
    assert analysis.phrase_regions(np.zeros(RATE), RATE) == []
    assert analysis.fit_grid(np.zeros(RATE * 10), RATE, 120) is None


def test_alignment():
    late = np.roll(beat(120, 8, 0.0), int(0.035 * RATE))
    _, moved, confidence = analysis.align([late], RATE, 120)
    assert abs(moved / RATE - 0.035) < 0.003 and confidence > 1.6


def test_greedy_dedupe_compares_with_the_first_vector():
    at = lambda deg: [np.cos(np.radians(deg)), np.sin(np.radians(deg))]
    hits = [{"start": i, "peak": p, "fingerprint": at(d)} for i, (d, p) in enumerate([(0, 0.5), (18, 0.9), (36, 0.8)])]
    assert [h["start"] for h in analysis.dedupe_hits(hits)] == [1, 2]


@pytest.mark.parametrize("bits,tolerance", [(16, 1e-4), (24, 1e-6)])
def test_wav(bits, tolerance):
    x = np.stack([tone(0.1), tone(0.1, 330.0)])
    rate, y = codec.parse_wav(codec.encode_wav(list(x), 44100, bits, [0, 10**9]))
    assert rate == 44100 and np.abs(x - y).max() < tolerance
    with pytest.raises(codec.Unsupported):
        codec.parse_wav(b"RIFF....NOPE")


def test_aiff():
    import struct

    rate = struct.pack(">HQ", 16383 + 15, int(44100 * 2**48))
    comm = struct.pack(">HIH", 1, 4, 16) + rate
    data = struct.pack(">II4h", 0, 0, 1000, -1000, 32767, -32768)
    body = b"AIFFCOMM" + struct.pack(">I", len(comm)) + comm + b"SSND" + struct.pack(">I", len(data)) + data
    got, x = codec.parse_aiff(b"FORM" + struct.pack(">I", len(body)) + body)
    assert got == 44100 and (x[0] * 32768).tolist() == [1000, -1000, 32767, -32768]


@pytest.mark.parametrize("seed", range(40))
def test_remix(seed):
    grid = remix.Grid(64, 4, 16)
    r = remix.generate(grid, seed, list(remix.STYLES)[seed % 9], activity=70, depth=80, profile=list(remix.PROFILES)[seed % 8])
    assert remix.signature(r, grid) == remix.signature(remix.generate(grid, seed, list(remix.STYLES)[seed % 9], activity=70, depth=80, profile=list(remix.PROFILES)[seed % 8]), grid)
    assert remix.departure(r) > 0 and all(0 <= s.src < 64 for s in r["steps"])
    if seed < 4:
        x = beat(120, 8)
        y = remix.render([x], RATE, r)
        assert len(y[0]) == len(x) and np.isfinite(y[0]).all() and np.abs(y[0]).max() <= np.abs(x).max() + 1e-6


def test_fx_bank():
    x = beat(170, 6, 0.0)
    found = analysis.analyse_break(x, RATE, 170)
    bank = fx.plan_bank(fx.pools(found, x, RATE), found["grid"]["beat"], 6, 0.6, seed=5)
    assert len(bank) == 6 and [r["heat"] for r in bank] == sorted(r["heat"] for r in bank)
    for r in bank[:3]:
        y = fx.render(fx.fragment([x], RATE, r["source"]["start"], r["source"]["end"]), RATE, r)
        assert np.isfinite(y[0]).all() and 0 < np.abs(y[0]).max() <= 0.921
        assert fx.mutate(r, 9) != r
        back = fx.snap_back([x], RATE, found["grid"], r["source"], y)
        assert np.isfinite(back["channels"][0]).all() and back["return_at"] > back["fx_start"]


def test_claimed_names():
    assert sequential.claim(["a.wav", "A.wav", "a 2.wav", "b"]) == ["a.wav", "A 2.wav", "a 2 2.wav", "b"]
