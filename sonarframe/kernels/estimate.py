"""Key and tempo of a signal: chroma against key profiles, and the period of the onset curve."""

from __future__ import annotations

import numpy as np

from sonarframe.functions.music import NOTES
from sonarframe.kernels.analysis import envelope

#: Probe-tone ratings of the scale degrees from the tonic on (Krumhansl and Kessler, 1982).
PROFILES = {"major": (6.35, 2.23, 3.48, 2.33, 4.38, 4.09, 2.52, 5.19, 2.39, 3.66, 2.29, 2.88), "minor": (6.33, 2.68, 3.52, 5.38, 2.60, 3.53, 2.54, 4.75, 3.98, 2.69, 3.34, 3.17)}
FRAME, HERTZ, LEAST_STRENGTH = 0.37, (55.0, 1760.0), 0.3
#: A tempo is taken only strictly between these.
BPM = (40.0, 220.0)


def chroma(x: np.ndarray, rate: float) -> np.ndarray:
    """Energy by pitch class (C first) of spectral peaks in whole frames, each frame weighing the same as its loudness' root."""
    size = 1 << int(np.ceil(np.log2(max(2.0, FRAME * rate))))
    x = np.asarray(x, dtype=np.float64)
    if len(x) < size:
        x = np.pad(x, (0, size - len(x)))
    window, total = np.hanning(size), np.zeros(12)
    hertz = np.fft.rfftfreq(size, 1 / rate)
    inside = np.flatnonzero((hertz >= HERTZ[0]) & (hertz <= min(HERTZ[1], rate / 2.2)))
    for at in range(0, len(x) - size + 1, size // 2):
        level = np.abs(np.fft.rfft(x[at : at + size] * window))
        peak = inside[(level[inside] > level[inside - 1]) & (level[inside] >= level[np.minimum(inside + 1, len(level) - 1)])]
        if not len(peak) or level[peak].max() <= 1e-9:
            continue
        # the place between bins from a parabola through three
        a, b, c = (np.log(level[np.minimum(peak + d, len(level) - 1)] + 1e-12) for d in (-1, 0, 1))
        place = peak + 0.5 * (a - c) / np.minimum(a - 2 * b + c, -1e-9)
        note = np.round(12 * np.log2(place * rate / size / 440.0)).astype(int) + 9
        found = np.bincount(note % 12, level[peak], 12)
        total += found / np.sqrt(found.sum())
    return total


def key(x: np.ndarray, rate: float) -> tuple[str, str, float] | None:
    """(note, major or minor, correlation) of the best of 24 keys; None where no profile fits."""
    c = chroma(x, rate)
    if c.std() <= 1e-12:
        return None
    scores = [(float(np.corrcoef(np.roll(c, -root), profile)[0, 1]), NOTES[root], mode) for mode, profile in PROFILES.items() for root in range(12)]
    strength, note, mode = max(scores, key=lambda s: s[0])
    return (note, mode, strength) if strength >= LEAST_STRENGTH else None


def tempo(x: np.ndarray, rate: float) -> float | None:
    """Beats a minute: the lag whose multiples meet most of the onset curve's autocorrelation, near 120 likelier; None outside BPM or without onsets."""
    hop = 0.005
    level = envelope(x, rate, 20, 1000 * hop)[1]
    flux = np.maximum(0, np.diff(np.log1p(100 * level), prepend=0.0))
    if len(flux) < 4 * 60 / BPM[1] / hop or flux.sum() <= 0:
        return None
    flux = flux - flux.mean()
    size = 1 << int(np.ceil(np.log2(2 * len(flux))))
    auto = np.fft.irfft(np.abs(np.fft.rfft(flux, size)) ** 2)[: len(flux)] / np.arange(len(flux), 0, -1)
    if auto[0] <= 0:
        return None
    lags = np.arange(60 / BPM[1] / hop, min(60 / BPM[0] / hop, len(flux) / 2), 0.1)
    if not len(lags):
        return None
    times = [np.interp(k * lags, np.arange(len(auto)), auto, right=0.0) for k in (1, 2, 4)]
    bpm = 60 / (lags * hop)
    score = (times[0] + 0.5 * times[1] + 0.5 * times[2]) * np.exp(-0.5 * (np.log2(bpm / 120) / 0.9) ** 2)
    best = float(bpm[int(np.argmax(score))])
    return best if score.max() > 0 and BPM[0] < best < BPM[1] else None


def key_and_tempo(x: np.ndarray, rate: float, want_key: bool = True, want_tempo: bool = True) -> dict:
    found, bpm = key(x, rate) if want_key else None, tempo(x, rate) if want_tempo else None
    note, scale, strength = found or (None, None, None)
    return {"key": note, "scale": scale, "strength": strength, "bpm": bpm}
