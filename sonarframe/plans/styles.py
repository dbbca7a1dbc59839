"""Remix styles, batch profiles and presets: values that a recipe's generator weighs its choices with, and words for them."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from sonarframe.kernels.rng import Rng

LEVELS = ("bar", "halfBar", "beat", "halfBeat", "slice", "micro")
FAMILIES = ("structural", "micro", "break")


@dataclass(frozen=True)
class Style:
    """Weights of levels, families and operations; factors on the sliders; where in a bar it likes to work."""

    key: str
    levels: Mapping[str, float]
    families: Mapping[str, float]
    operations: Mapping[str, float]
    structure: float = 1.0
    activity: float = 1.0
    depth: float = 1.0
    roll: float = 1.0
    pitch: float = 1.0
    position: Mapping[str, float] = field(default_factory=dict)
    roll_position: Mapping[str, float] | None = None
    unlocks: Mapping[str, float] = field(default_factory=dict)


# Weights of the levels bar, halfBar, beat, halfBeat, slice, micro.
_LEVELS = {
    "gentle": (0.3, 0.8, 1.4, 0.6, 0.2, 0),
    "groove": (0.2, 0.7, 2.2, 1.6, 0.5, 0.15),
    "phrase": (2.2, 2.0, 0.9, 0.25, 0.1, 0.05),
    "fill": (0.3, 0.8, 1.8, 1.2, 0.5, 0.3),
    "repeater": (0.8, 1.8, 1.8, 0.9, 0.3, 0.15),
    "cutup": (0.15, 0.5, 1.2, 1.8, 2.2, 1.4),
    "reconstruct": (1.8, 1.8, 1.6, 0.7, 0.3, 0.15),
    "wild": (1.2, 1.3, 1.4, 1.2, 1.2, 0.9),
    "mixed": (1.2, 1.4, 1.5, 0.9, 0.5, 0.25),
}
# Weights of the families structural, micro, break.
_FAMILIES = {
    "gentle": (3, 0.5, 0.15), "groove": (2.4, 1.1, 0.5), "phrase": (3.4, 0.6, 0.25), "fill": (1.1, 1.5, 0.6), "repeater": (3.6, 0.7, 0.2),
    "cutup": (1.2, 3, 1), "reconstruct": (3, 1.2, 0.6), "wild": (2, 2, 1.2), "mixed": (2.6, 1.1, 0.5),
}
# Weights of operations within their family (a roll's is 1).
_OPERATIONS = {
    "gentle": {"preserve": 1.5, "repeat-node": 1.6, "substitute-near": 1.5, "repeat-half": 1.2, "motif-return": 0.7, "call-response": 0.6, "aba": 0.5, "swap-halves": 0.4, "jump": 0.2, "reverse-slice": 0.5, "micro-repeat": 0.4, "reverse-node": 0.2, "micro-shuffle": 0.15, "stutter": 0.1, "silence": 0.2, "gap": 0.1},
    "groove": {"repeat-node": 1.8, "repeat-half": 1.8, "aba": 1.6, "substitute-near": 1.4, "swap-halves": 1.2, "call-response": 1.1, "micro-repeat": 1.1, "jump": 0.7, "motif-return": 0.5, "preserve": 0.6, "micro-shuffle": 0.8, "reverse-slice": 0.6, "reverse-node": 0.4, "stutter": 0.6, "silence": 0.7, "gap": 0.6},
    "phrase": {"repeat-node": 1.8, "motif-return": 1.9, "call-response": 1.7, "substitute-near": 1.6, "swap-halves": 1.4, "aba": 1.4, "repeat-half": 1.2, "jump": 1.0, "preserve": 0.9, "reverse-node": 0.5, "micro-repeat": 0.4, "reverse-slice": 0.3, "micro-shuffle": 0.2, "stutter": 0.2, "silence": 0.3, "gap": 0.4},
    "fill": {"micro-repeat": 1.8, "repeat-node": 1.2, "reverse-node": 1.0, "reverse-slice": 0.9, "repeat-half": 0.9, "stutter": 0.9, "gap": 0.8, "preserve": 0.8, "substitute-near": 0.5, "micro-shuffle": 0.5, "silence": 0.5, "aba": 0.3, "call-response": 0.3, "motif-return": 0.2, "swap-halves": 0.2, "jump": 0.1},
    "repeater": {"repeat-node": 3, "repeat-half": 2.4, "aba": 2.0, "motif-return": 1.6, "call-response": 1.3, "micro-repeat": 1.2, "substitute-near": 0.7, "preserve": 0.6, "swap-halves": 0.4, "jump": 0.3, "reverse-slice": 0.3, "reverse-node": 0.3, "micro-shuffle": 0.2, "stutter": 0.25, "silence": 0.2, "gap": 0.3},
    "cutup": {"stutter": 2.4, "micro-shuffle": 2.0, "reverse-slice": 1.8, "micro-repeat": 1.6, "reverse-node": 1.2, "jump": 1.2, "substitute-near": 1.0, "silence": 1.0, "repeat-node": 0.8, "swap-halves": 0.7, "gap": 0.6, "repeat-half": 0.5, "aba": 0.4, "call-response": 0.3, "motif-return": 0.2, "preserve": 0.3},
    "reconstruct": {"jump": 2.2, "substitute-near": 2.0, "swap-halves": 1.8, "motif-return": 1.4, "repeat-node": 1.2, "aba": 1.0, "call-response": 1.0, "repeat-half": 0.9, "reverse-node": 0.8, "micro-shuffle": 0.7, "micro-repeat": 0.6, "reverse-slice": 0.5, "stutter": 0.4, "silence": 0.5, "gap": 0.5, "preserve": 0.4},
    "wild": {"jump": 1.4, "stutter": 1.3, "micro-shuffle": 1.2, "reverse-node": 1.2, "reverse-slice": 1.2, "substitute-near": 1.2, "repeat-node": 1.2, "swap-halves": 1.1, "micro-repeat": 1.1, "aba": 1.0, "repeat-half": 1.0, "call-response": 1.0, "motif-return": 1.0, "silence": 1.0, "gap": 0.9, "preserve": 0.3},
    "mixed": {"repeat-node": 1.6, "substitute-near": 1.5, "repeat-half": 1.3, "motif-return": 1.3, "call-response": 1.2, "aba": 1.1, "swap-halves": 1.0, "jump": 1.0, "micro-repeat": 0.9, "preserve": 0.8, "reverse-node": 0.7, "reverse-slice": 0.7, "micro-shuffle": 0.5, "stutter": 0.5, "silence": 0.5, "gap": 0.4},
}
# Factors on structure, activity, depth, rolls and pitch.
_FACTORS = {
    "gentle": (1.25, 0.5, 0.5, 0.35, 0.35), "groove": (1.05, 1, 0.9, 0.8, 0.6), "phrase": (1.1, 0.85, 0.85, 0.5, 1.25), "fill": (1.2, 0.45, 1.0, 2.2, 0.7), "repeater": (1.1, 1, 0.8, 0.7, 0.95),
    "cutup": (0.7, 1.2, 1.25, 1.2, 0.6), "reconstruct": (0.75, 1.15, 1.1, 0.6, 0.95), "wild": (0.55, 1.4, 1.45, 1.3, 1.4), "mixed": (1, 1, 1, 0.9, 1.0),
}
# Factors on places, on places of rolls where they differ, and depths from which an operation is allowed.
_POSITIONS = {
    "gentle": {"downbeat": 0.5, "offBeat": 1.3}, "groove": {"endOfBar": 1.3, "offBeat": 1.2}, "phrase": {"endOfPhrase": 1.4, "late": 1.2}, "fill": {"endOfBar": 4.5, "endOfPhrase": 5, "lastBar": 2.6, "late": 1.8, "downbeat": 0.25},
    "repeater": {"late": 1.3}, "cutup": {"offBeat": 1.4, "downbeat": 0.7}, "mixed": {"endOfBar": 1.3, "late": 1.15},
}
_ROLL_POSITIONS = {"fill": {"endOfBar": 5, "endOfPhrase": 6, "lastBar": 3, "late": 2}}
_UNLOCKS = {"cutup": {"stutter": 0.05, "micro-shuffle": 0, "silence": 0}, "wild": {"stutter": 0, "silence": 0, "micro-shuffle": 0, "reverse-node": 0, "gap": 0.05}}

STYLES = {
    key: Style(key, dict(zip(LEVELS, _LEVELS[key])), dict(zip(FAMILIES, _FAMILIES[key])), _OPERATIONS[key], *_FACTORS[key], _POSITIONS.get(key, {}), _ROLL_POSITIONS.get(key), _UNLOCKS.get(key, {}))
    for key in _LEVELS
}
DEFAULT_STYLE = "mixed"


def style(key: str | None) -> Style:
    return STYLES.get(key or "", STYLES[DEFAULT_STYLE])


@dataclass(frozen=True)
class Profile:
    """One variation's lean away from the settings: factors on the sliders, on a new opening, on levels and families."""

    key: str
    label: str = ""
    structure: float = 1.0
    activity: float = 1.0
    depth: float = 1.0
    entry: float = 1.0
    roll: float = 1.0
    pitch: float = 1.0
    levels: Mapping[str, float] = field(default_factory=dict)
    families: Mapping[str, float] = field(default_factory=dict)


def _profile(key: str, label: str, factors: tuple, levels: tuple, families: tuple) -> Profile:
    return Profile(key, label, *factors, dict(zip(LEVELS, levels)), dict(zip(FAMILIES, families)))


# Structure, activity, depth, entry, roll, pitch; levels; families.
_PROFILES = (
    _profile("faithful", "close to the original", (1.3, 0.55, 0.6, 0.25, 0.5, 0.4), (0.5, 0.9, 1.2, 1, 0.7, 0.4), (1.5, 0.7, 0.5)),
    _profile("structural", "structural repetition", (1.15, 1, 0.85, 0.9, 0.6, 0.6), (1.1, 1.5, 1.2, 0.6, 0.3, 0.2), (2, 0.5, 0.4)),
    _profile("rearranged", "phrase rearrangement", (0.65, 1.1, 1.05, 1.7, 0.7, 0.8), (1.9, 1.7, 0.9, 0.4, 0.25, 0.15), (1.9, 0.6, 0.6)),
    _profile("melodic", "pitch mutation", (1.1, 0.8, 1, 0.8, 0.7, 2.6), (0.7, 1.2, 1.4, 0.8, 0.5, 0.3), (1.6, 0.8, 0.3)),
    _profile("one-gesture", "mostly untouched, one big gesture", (1.35, 0.3, 1.5, 0.4, 2.4, 0.7), (0.4, 0.8, 1.5, 1.2, 0.8, 0.6), (1, 1.4, 0.8)),
    _profile("beatwise", "beat-level reconstruction", (0.85, 1.25, 1, 1.2, 0.9, 0.6), (0.3, 0.8, 2.2, 1.5, 0.6, 0.3), (1.6, 1.2, 0.7)),
    _profile("substituted", "large-scale substitution", (0.6, 0.9, 1.15, 1.6, 0.6, 0.9), (2.2, 1.4, 0.7, 0.35, 0.2, 0.1), (2.2, 0.5, 0.7)),
    _profile("fractured", "multi-scale mutation", (0.55, 1.35, 1.4, 1.4, 1.3, 0.9), (0.9, 1, 1.2, 1.3, 1.6, 1.2), (1.1, 2, 1.2)),
)
PROFILES = {p.key: p for p in _PROFILES}
NEUTRAL = Profile("neutral")


def profile(key: str | None) -> Profile:
    return PROFILES.get(key or "", NEUTRAL)


def batch_profiles(rng: Rng, count: int) -> list[str]:
    """The faithful one first, then the others in a shuffled round, again and again; one at least."""
    others = rng.shuffle([k for k in PROFILES if k != "faithful"])
    return ["faithful", *(others[i % len(others)] for i in range(count - 1))]


SETTINGS = ("subdivision", "style", "structure", "activity", "depth", "rolls", "pitch_mode", "pitch_amount")
# The settings of each preset, in the order of SETTINGS.
_PRESETS = {
    "subtle": ("1/8", "gentle", 88, 25, 30, 15, "inkey", 20),
    "barswap": ("1/2bar", "phrase", 45, 55, 50, 20, "inkey", 30),
    "newgroove": ("1/8", "groove", 70, 60, 50, 40, "inkey", 25),
    "fills": ("1/16", "fill", 85, 30, 65, 90, "inkey", 25),
    "melodic": ("1/4", "phrase", 72, 45, 60, 25, "inkey", 85),
    "stutter": ("1/16", "cutup", 45, 65, 80, 65, "octaves", 25),
    "rebuild": ("1/4", "reconstruct", 30, 70, 65, 40, "inkey", 45),
    "destroy": ("1/16", "wild", 12, 88, 95, 80, "mixed", 65),
}
PRESETS = {key: dict(zip(SETTINGS, values)) for key, values in _PRESETS.items()}
DEFAULT_SETTINGS = dict(zip(SETTINGS, ("1/16", "mixed", 65, 45, 50, 35, "inkey", 45)))


def preset(key: str | None) -> dict | None:
    return PRESETS.get(key or "")


def match_preset(settings: Mapping) -> str | None:
    """The preset whose settings these are, all of them; else None."""
    return next((key for key, values in PRESETS.items() if values.items() <= dict(settings).items()), None)


# Words from each percentage on.
_WORDS = {
    "structure": ((85, "structure held"), (60, "bars stay put"), (35, "bars can move"), (15, "loose"), (0, "anything goes")),
    "activity": ((85, "constant"), (60, "busy"), (35, "occasional"), (15, "sparse"), (0, "almost nothing")),
    "depth": ((85, "extreme"), (60, "bold"), (35, "moderate"), (15, "subtle"), (0, "barely there")),
    "intensity": ((90, "destructive"), (75, "wrecked"), (55, "loose"), (35, "recognisable"), (15, "conservative"), (0, "barely touched")),
    "melt": ((80, "what happened"), (60, "malfunction"), (40, "melting"), (20, "grainy"), (0, "stretched")),
}


def describe(what: str, value: float | None) -> str:
    """The word for a slider (structure, activity, depth, intensity, melt) at a value of 0 to 100; no number counts as 0."""
    v = min(100.0, max(0.0, float(value or 0)))
    return next(word for least, word in _WORDS[what] if v >= least)
