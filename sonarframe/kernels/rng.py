"""Reproducible 32-bit generators: equal seeds give equal streams on every executor."""

from __future__ import annotations

MASK = 0xFFFFFFFF


def hash_seed(seed: int | float | str) -> int:
    """A uint32: numbers modulo 2**32 (0 becomes 1), text by FNV-1a over UTF-16 units."""
    if isinstance(seed, str):
        h = 2166136261
        raw = seed.encode("utf-16-le")
        for i in range(0, len(raw), 2):
            h = ((h ^ (raw[i] | raw[i + 1] << 8)) * 16777619) & MASK
        return h
    return (int(seed) & MASK) or 1


def derive_seed(base: int | str, context: int) -> int:
    c = context & MASK
    return ((((hash_seed(base) ^ c) * 0x9E3779B1) & MASK) ^ (c << 13)) & MASK


def region_seed(base: int | None, index: int) -> int:
    """Seed of a region of a file with a base seed."""
    return ((1 if base is None else base) ^ ((index + 1) * 2654435761)) & MASK


class Rng:
    """The mulberry32 stream (public domain, T. Ettinger)."""

    def __init__(self, seed: int | str = 1):
        self.state = hash_seed(seed)

    def next(self) -> float:
        self.state = (self.state + 0x6D2B79F5) & MASK
        t = self.state
        t = ((t ^ (t >> 15)) * (t | 1)) & MASK
        t ^= (t + (((t ^ (t >> 7)) * (t | 61)) & MASK)) & MASK
        return ((t ^ (t >> 14)) & MASK) / 4294967296

    def signed(self) -> float:
        return 2 * self.next() - 1

    def range(self, low: float, high: float) -> float:
        return low + (high - low) * self.next()

    def int(self, n: int) -> int:
        return min(n - 1, int(n * self.next()))

    def bool(self, p: float = 0.5) -> bool:
        return self.next() < p

    def weighted(self, weights: list[float]) -> int:
        """Index drawn in proportion to the positive weights; the last of them if rounding runs past the end."""
        left = self.next() * sum(w for w in weights if w > 0)
        last = 0
        for i, w in enumerate(weights):
            if w > 0:
                left -= w
                last = i
                if left <= 0:
                    return i
        return last

    def shuffle(self, items: list) -> list:
        out = list(items)
        for i in range(len(out) - 1, 0, -1):
            j = self.int(i + 1)
            out[i], out[j] = out[j], out[i]
        return out


class XorShift:
    """The xorshift32 stream (Marsaglia, 2003) that noise comes from."""

    def __init__(self, seed: int):
        self.state = (seed & MASK) or 0xCAFE15B0

    def _step(self) -> int:
        s = self.state
        s ^= (s << 13) & MASK
        s ^= s >> 17
        s ^= (s << 5) & MASK
        self.state = s
        return s

    def white(self) -> float:
        s = self._step()
        return (s - (1 << 32) if s >> 31 else s) / 2147483648

    def uniform(self) -> float:
        return (self._step() & 0x7FFFFFFF) / 2147483648


def macro_values(macros: list[str], current: dict[str, float] | None, rng: Rng) -> dict[str, float]:
    """New 0..100 values for the macros of a character."""
    return (current or {}) | {m: int(rng.next() * 100 + 0.5) for m in macros}


def random_seed(rng: Rng) -> int:
    return int(rng.next() * 1_000_000)
