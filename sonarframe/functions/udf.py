"""Kernels as column functions: Arrow-batched, one whole signal a row.

Signal columns are array<float>; signals stay numpy arrays on their way to and from
Arrow.  ``bounded`` limits the bytes of an Arrow batch, as rows can hold minutes of audio.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from sonarframe.kernels import analysis, estimate, primitives, stages, stretch

BATCH_BYTES = 32 << 20


def bounded(spark: SparkSession) -> None:
    """Arrow batches of at most BATCH_BYTES (or one row), unless the session sets its own limit."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name, None) is None:
        spark.conf.set(name, str(BATCH_BYTES))


REGIONS = "array<struct<start:double,end:double>>"


def _signal(s) -> np.ndarray:
    return np.asarray(s if s is not None else [], dtype=np.float32)


def signal_udf(f: Callable[[np.ndarray], object], kind: str) -> Callable[..., Column]:
    """A pandas function of one signal column; null signals give null."""

    def run(x: pd.Series) -> pd.Series:
        return x.map(lambda s: None if s is None else f(_signal(s)))

    def run_struct(x: pd.Series) -> pd.DataFrame:
        names = [part.split(":")[0] for part in re.findall(r"\w+:[a-z]+", kind)]
        rows = [(None if s is None else f(_signal(s))) or {} for s in x]
        return pd.DataFrame([{n: r.get(n) for n in names} for r in rows], columns=names)

    return F.pandas_udf(run_struct if kind.startswith("struct") else run, kind)


def envelope(rate: float, window_ms: float = 25, hop_ms: float = 10):
    return signal_udf(lambda x: analysis.envelope(x, rate, window_ms, hop_ms)[1], "array<double>")


def onsets(rate: float, sensitivity: float = 0.65, spacing: float = 0.12):
    def find(x: np.ndarray) -> list[float]:
        t, s = analysis.band_onsets(x, rate)
        return t[analysis.pick_onsets(t, s, sensitivity, spacing)].tolist()

    return signal_udf(find, "array<double>")


def beat_grid(rate: float, bpm: float):
    return signal_udf(lambda x: analysis.fit_grid(x, rate, bpm), "struct<bpm:double,downbeat:double,confidence:double>")


def _pairs(regions: list) -> list[dict]:
    return [{"start": float(a), "end": float(b)} for a, b in regions]


def phrases(rate: float, params: dict | None = None):
    return signal_udf(lambda x: _pairs(analysis.phrase_regions(x, rate, params)), REGIONS)


def drums(rate: float, params: dict | None = None, bpm: float | None = None):
    return signal_udf(lambda x: _pairs(analysis.drum_regions(x, rate, params, bpm)), REGIONS)


def one_shots(rate: float):
    return signal_udf(lambda x: analysis.one_shots(x, rate), "array<struct<start:double,end:double,low:double,mid:double,high:double,peak:double,label:string,fingerprint:array<double>>>")


def key_and_tempo(rate: float, key: bool = True, tempo: bool = True):
    """struct(key, scale, strength, bpm): what ``kernels.estimate`` finds, null for what isn't wanted or clear."""
    return signal_udf(lambda x: estimate.key_and_tempo(x, rate, key, tempo), "struct<key:string,scale:string,strength:double,bpm:double>")


def features(rate: float):
    """Loudness, flatness, band levels and fingerprint."""

    def measure(x: np.ndarray) -> dict:
        low, mid, high = analysis.band_energies(x, rate)
        return {"loudness": analysis.loudness(x, rate), "flatness": analysis.flatness(x, rate), "low": low, "mid": mid, "high": high, "fingerprint": analysis.fingerprint(x, rate)}

    return signal_udf(measure, "struct<loudness:double,flatness:double,low:double,mid:double,high:double,fingerprint:array<double>>")


def _mono(f: Callable[[list[np.ndarray]], list[np.ndarray]]) -> Callable[..., Column]:
    return signal_udf(lambda x: np.asarray(f([x])[0], dtype=np.float32), "array<float>")


def stretched(rate: float, ratio: float, character: str = stretch.DEFAULT_CHARACTER, macros: dict | None = None, seed: int = 1):
    return _mono(lambda c: stretch.stretch(c, rate, ratio, character, macros, seed))


def pitched(rate: float, semitones: float, character: str = "transient", seed: int = 1):
    return _mono(lambda c: stretch.pitch_shift(c, rate, semitones, character, seed=seed))


def staged(rate: float, mode: str, mix: float = 100, intensity: float = 50, seed: int = 1):
    return _mono(lambda c: stages.output_stage(c, rate, mode, mix, intensity, seed))


def lofi(rate: float, settings: dict, seed: int = 1):
    return _mono(lambda c: stages.lofi(c, rate, settings, seed))


def primitive(key: str, rate: float, **params: float):
    """A registered primitive with its defaults, but for what is given."""
    p = primitives.get(key)
    settings = {s.key: s.default for s in p.params} | params
    return _mono(lambda c: p.run(c, rate, settings))


def register_primitives(spark: SparkSession, rate: float) -> None:
    """Every registered primitive as a SQL function ``primitive_<key>``."""
    for key in primitives.keys():
        spark.udf.register(f"primitive_{key}", primitive(key, rate))
