"""Recursive filters and followers.

Linear recurrences run by blocks: a block's response from rest is one matrix product
and only the state at block ends is carried on, so there's no loop over samples.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

BLOCK = 128


@lru_cache(maxsize=256)
def _responses(b: tuple[float, ...], a: tuple[float, ...]):
    """Lower-triangular impulse matrix of a block, the effect of each state on outputs, and of inputs and states on the next state."""
    order = len(a)
    b = b + (0.0,) * (order + 1 - len(b))

    def run(x: np.ndarray, z: list[float]) -> tuple[np.ndarray, list[float]]:
        y = np.empty(len(x))
        for n, v in enumerate(x):  # transposed direct form, over one block only
            y[n] = b[0] * v + z[0]
            z = [b[i + 1] * v - a[i] * y[n] + (z[i + 1] if i + 1 < order else 0.0) for i in range(order)]
        return y, z

    h, _ = run(np.eye(1, BLOCK)[0], [0.0] * order)
    impulse = np.array([[h[i - j] if i >= j else 0.0 for j in range(BLOCK)] for i in range(BLOCK)])
    by_state = [run(np.zeros(BLOCK), [float(i == k) for i in range(order)]) for k in range(order)]
    next_from_input = np.array([run(np.eye(1, BLOCK, j)[0], [0.0] * order)[1] for j in range(BLOCK)])
    return impulse.T, np.array([y for y, _ in by_state]), next_from_input, np.array([z for _, z in by_state])


def recursive(x: np.ndarray, b: tuple[float, ...], a: tuple[float, ...]) -> np.ndarray:
    """y[n] = sum(b[i] x[n-i]) - sum(a[i] y[n-1-i]), from rest."""
    n = len(x)
    if not n:
        return np.zeros(0)
    impulse, from_state, state_in, state_state = _responses(tuple(b), tuple(a))
    blocks = np.zeros((-(-n // BLOCK), BLOCK))
    blocks.ravel()[:n] = x
    y, pushed = blocks @ impulse, blocks @ state_in
    state = np.zeros((len(blocks), len(a)))
    for k in range(1, len(blocks)):
        state[k] = pushed[k - 1] + state[k - 1] @ state_state
    return (y + state @ from_state).ravel()[:n]


def one_pole(x: np.ndarray, cutoff: float, rate: float) -> np.ndarray:
    """RC low pass: coefficient dt / (rc + dt)."""
    rc, dt = 1 / (2 * np.pi * cutoff), 1 / rate
    k = dt / (rc + dt)
    return recursive(x, (k,), (k - 1,)).astype(np.float32)


def one_pole_high(x: np.ndarray, cutoff: float, rate: float) -> np.ndarray:
    return (x - one_pole(x, cutoff, rate)).astype(np.float32)


def smooth(x: np.ndarray, cutoff: float, rate: float) -> np.ndarray:
    """Low pass with the exponential coefficient that the output stages use."""
    k = 1 - np.exp(-2 * np.pi * cutoff / rate)
    return recursive(x, (k,), (k - 1,))


def smooth_high(x: np.ndarray, cutoff: float, rate: float) -> np.ndarray:
    return x - smooth(x, cutoff, rate)


def peak_eq(x: np.ndarray, rate: float, freq: float, q: float, gain_db: float) -> np.ndarray:
    """Peaking filter by the audio-EQ cookbook (R. Bristow-Johnson)."""
    w, g = 2 * np.pi * freq / rate, 10 ** (gain_db / 40)
    alpha = np.sin(w) / (2 * q)
    a0 = 1 + alpha / g
    return recursive(x, ((1 + alpha * g) / a0, -2 * np.cos(w) / a0, (1 - alpha * g) / a0), (-2 * np.cos(w) / a0, (1 - alpha / g) / a0))


def low_shelf(x: np.ndarray, rate: float, freq: float, gain_db: float, slope: float = 1.0) -> np.ndarray:
    """Low shelf by the same cookbook."""
    w, g = 2 * np.pi * freq / rate, 10 ** (gain_db / 40)
    c, alpha = np.cos(w), np.sin(w) / 2 * np.sqrt((g + 1 / g) * (1 / slope - 1) + 2)
    s = 2 * np.sqrt(g) * alpha
    a0 = (g + 1) + (g - 1) * c + s
    b = (g * ((g + 1) - (g - 1) * c + s), 2 * g * ((g - 1) - (g + 1) * c), g * ((g + 1) - (g - 1) * c - s))
    return recursive(x, tuple(v / a0 for v in b), (-2 * ((g - 1) + (g + 1) * c) / a0, ((g + 1) + (g - 1) * c - s) / a0))


def follower(x: np.ndarray, rate: float, attack_ms: float, release_ms: float) -> np.ndarray:
    """Envelope with its own times up and down: the coefficient depends on the state, so this one is serial."""
    up, down = np.exp(-1 / (0.001 * attack_ms * rate)), np.exp(-1 / (0.001 * release_ms * rate))
    env, out = 0.0, []
    for v in np.abs(x).tolist():
        k = up if v > env else down
        env = k * env + (1 - k) * v
        out.append(env)
    return np.array(out)


def leaky(x: np.ndarray, keep: float) -> np.ndarray:
    return recursive(x, (1 - keep,), (-keep,))


def decay_peak(x: np.ndarray, decay: float, start: float = 1e-6) -> np.ndarray:
    """max(x[n], p[n-1] * decay): a running maximum after the decay is taken out, in blocks that stay in range."""
    out = np.empty(len(x))
    held, step = start, max(1, int(min(4096, 600 / max(1e-9, -np.log(max(decay, 1e-12))))))
    for i in range(0, len(x), step):
        part = x[i : i + step]
        powers = decay ** np.arange(1, len(part) + 1)
        out[i : i + step] = np.maximum(np.maximum.accumulate(part / powers), held) * powers
        held = out[i + len(part) - 1]
    return out


def dc_block(x: np.ndarray, r: float = 0.995) -> np.ndarray:
    return recursive(x, (1.0, -1.0), (-r,)).astype(np.float32)


def delayed(x: np.ndarray, delay: np.ndarray | float) -> np.ndarray:
    """x at n - delay[n] by linear interpolation, silence before the start."""
    at = np.arange(len(x)) - delay
    low = np.floor(at).astype(np.int64)
    share = at - low
    padded = np.concatenate([[0.0], x, [0.0]])
    take = lambda i: padded[np.clip(i + 1, 0, len(x))]
    return take(low) * (1 - share) + take(low + 1) * share


def circular(x: np.ndarray, at: np.ndarray) -> np.ndarray:
    """x at fractional positions, round and round."""
    n = len(x)
    if not n:
        return np.zeros(0)
    at = np.mod(at, n)
    low = np.floor(at).astype(np.int64) % n
    share = at - np.floor(at)
    return x[low] * (1 - share) + x[(low + 1) % n] * share
