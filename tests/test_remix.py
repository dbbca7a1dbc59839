"""What styles, profiles and presets do to recipes, over many seeds."""

import numpy as np
import pytest

from sonarframe.functions.music import SCALES
from sonarframe.kernels.rng import Rng
from sonarframe.plans import remix, styles

GRID = remix.Grid(64, 4, 16)


def recipes(n=60, **settings):
    defaults = dict(style_key="mixed", structure=65, activity=45, depth=50, rolls=35, pitch_mode="inkey", pitch_amount=20)
    return [remix.generate(GRID, seed * 104729, **(defaults | settings)) for seed in range(1, n + 1)]


def mean(f, **settings):
    return float(np.mean([f(r) for r in recipes(**settings)]))


def leveled(r):
    return [e for e in r["edits"] if e["level"] != "phrase" and e["op"] != "pitch"]


def share(rows, holds):
    return sum(map(holds, rows)) / len(rows) if rows else 0.0


def test_every_style_differs_from_the_loop_and_repeats_by_seed():
    for key in styles.STYLES:
        for r, again in zip(recipes(10, style_key=key), recipes(10, style_key=key)):
            assert remix.departure(r) > 0 and r == again and all(0 <= s.src < 64 for s in r["steps"])


def test_edits_are_at_several_scales():
    assert len({e["level"] for r in recipes(activity=70) for e in r["edits"]}) >= 4


def test_phrase_is_coarse_and_cutup_fine():
    coarse = lambda r: share(leveled(r), lambda e: e["level"] in ("bar", "halfBar"))
    micro = lambda r: sum(s.stutter > 0 for s in r["steps"])
    assert mean(coarse, style_key="phrase", activity=70) > 0.4 and mean(coarse, style_key="cutup", activity=70) < 0.25
    assert mean(micro, style_key="cutup", activity=70) > 2 * mean(micro, style_key="phrase", activity=70)


def test_gentle_leaves_bars_alone_and_wild_does_not():
    gentle, wild = (mean(remix.departure, style_key=k) for k in ("gentle", "wild"))
    assert gentle < 0.2 and wild > 2 * gentle
    assert mean(lambda r: 1 - np.mean(remix.treatments(r, GRID)), style_key="gentle") > 0.5


def test_fill_works_late_in_bars():
    late = lambda r: share(leveled(r), lambda e: e["at"] % 16 >= 8)
    fill, other = (mean(late, style_key=k, activity=60, rolls=60) for k in ("fill", "reconstruct"))
    assert fill > 0.6 and fill > other + 0.15


def test_repeater_repeats():
    repeats = mean(lambda r: sum(e["op"] in ("repeat-node", "repeat-half", "micro-repeat", "aba", "motif-return") for e in r["edits"]), style_key="repeater", activity=70)
    assert repeats > 1 and repeats > mean(lambda r: sum(s.stutter > 0 for s in r["steps"]), style_key="repeater", activity=70, rolls=0)


def test_rolls():
    count = lambda r: sum(e["op"] == "roll" for e in r["edits"])
    assert mean(count, rolls=0) == 0 < mean(count) < mean(count, rolls=100)
    ends = {}
    for key in ("fill", "wild"):
        rolls = [e for r in recipes(90, style_key=key, rolls=80) for e in r["edits"] if e["op"] == "roll"]
        ends[key] = share(rolls, lambda e: (e["at"] + e["span"]) % 16 == 0)
    assert ends["fill"] > 0.5 and ends["fill"] > ends["wild"]
    for r in recipes(style_key="fill", rolls=100):
        for e in (e for e in r["edits"] if e["op"] == "roll"):
            slots = r["steps"][e["at"] : e["at"] + e["span"]]
            assert all(s.stutter >= 2 for s in slots) or len({s.src for s in slots}) <= -(-e["span"] // 2)


def test_pitch():
    moved = lambda r: np.mean([s.pitch != 0 for s in r["steps"]])
    assert mean(moved, pitch_amount=0) == 0 and mean(moved, pitch_mode="off", pitch_amount=100, activity=90, depth=90) == 0
    assert 0 < mean(moved, activity=60) < 0.35 and mean(moved, activity=60, pitch_amount=90) > mean(moved, activity=60)
    assert all(s.pitch % 12 in SCALES["minor"] for r in recipes(pitch_amount=90, depth=90) for s in r["steps"])
    assert all(s.pitch % 12 == 0 for r in recipes(pitch_mode="octaves", pitch_amount=90, depth=95) for s in r["steps"])


def test_batches_differ_by_profile():
    assert len(styles.PROFILES) == 8 and styles.profile("nothing") is styles.NEUTRAL
    for seed in range(5):
        batch = styles.batch_profiles(Rng(seed), 8)
        assert batch[0] == "faithful" and sorted(batch) == sorted(styles.PROFILES)
    assert styles.batch_profiles(Rng(1), 1) == styles.batch_profiles(Rng(1), 0) == ["faithful"] and len(styles.batch_profiles(Rng(1), 20)) == 20
    assert mean(remix.departure, profile="faithful") < mean(remix.departure, profile="fractured")
    assert len({remix.pattern(remix.generate(GRID, 5, profile=k)) for k in styles.PROFILES}) == 8


def test_presets_and_words():
    assert len(styles.PRESETS) == 8 and styles.preset("none") is None
    for key, settings in styles.PRESETS.items():
        assert styles.match_preset(settings) == key and styles.match_preset(settings | {"other": 1}) == key
        assert styles.match_preset(settings | {"structure": settings["structure"] + 1}) is None
        assert settings["style"] in styles.STYLES
    assert styles.match_preset(styles.DEFAULT_SETTINGS) is None
    assert [styles.describe("structure", v) for v in (100, 60, 35, 15, 0, None)] == ["structure held", "bars stay put", "bars can move", "loose", "anything goes", "anything goes"]
    assert [styles.describe("melt", v) for v in (0, 20, 40, 60, 80)] == ["stretched", "grainy", "melting", "malfunction", "what happened"]
    assert styles.describe("activity", 59) == "occasional" and styles.describe("depth", 14) == "barely there" and styles.describe("intensity", 95) == "destructive"


@pytest.mark.parametrize("count", [1, 3, 4, 16, 17, 64])
def test_short_loops(count):
    for seed in range(20):
        r = remix.generate(remix.Grid(count, 4, 16), seed, list(styles.STYLES)[seed % 9], activity=80, rolls=80, pitch_amount=80)
        assert len(r["steps"]) == count and all(0 <= s.src < count for s in r["steps"])
