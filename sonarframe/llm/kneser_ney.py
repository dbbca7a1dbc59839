"""Class-conditional Kneser-Ney models over bytes, for two classes at once.

A gram is up to ``ORDER`` bytes packed into a 64-bit key, so keys are exact.  The
counts of both classes come from whole texts through one aggregation; every lower
order follows from them (continuation counts).  Orders above ``SHARED`` are kept
by class; at ``SHARED`` and below both classes back off to the same pooled
continuation counts, so an expression rare in either class weighs little.

What scoring needs is the difference of the two log-probabilities of a byte, kept
for every gram seen, and the difference of the backoff weights of every context
seen; an unseen gram adds its context's weights and goes on with a shorter one.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sonarframe.llm import textnum as N
from sonarframe.llm.shared import drop, table
from sonarframe.llm.table import KeyTable

ORDER, SHARED = 6, 3
#: Grams of the highest order in a shard, about: a model has as many shards as its grams need.
SHARD_GRAMS = 1 << 20
#: Bytes of text scored at once where a model has several shards, each loaded once for them.
BLOCK_BYTES = 1 << 24
#: Bytes of text in a slice that is scored: a worker's arrays are a few dozen times that.
SLICE_BYTES = 1 << 17
#: Bytes of text whose grams are counted at once, about.
COUNTED = 1 << 21
_SPREAD = 2654435761

_EDGE = 0x0A  # stands before and after each text


def codes(data: np.ndarray) -> np.ndarray:
    """Bytes as the models see them: A-Z lower-cased, white space as 0x20, digits as 0."""
    out = N.LOWER.copy()
    out[N.IS_SPACE] = 0x20
    out[ord("0") : ord("9") + 1] = ord("0")
    return out[data]


def _grams(data: np.ndarray, offsets: np.ndarray, order: int) -> np.ndarray:
    """The key of the ``order`` bytes that end at each byte; bytes before a text are edges."""
    n = len(data)
    padded = np.concatenate([np.full(order - 1, _EDGE, dtype=np.uint8), data]).astype(np.uint64)
    key = np.zeros(n, dtype=np.uint64)
    for j in range(order):
        key |= padded[order - 1 - j : order - 1 - j + n] << np.uint64(8 * j)
    for k in range(1, order):  # the first bytes of a text don't see the text before
        at = offsets[:-1] + k - 1
        at = at[(at < offsets[1:])]
        keep = np.uint64((1 << (8 * k)) - 1)
        fill = np.uint64(sum(_EDGE << (8 * j) for j in range(k, order)))
        key[at] = (key[at] & keep) | fill
    return key


def count(labelled: DataFrame, order: int = ORDER) -> DataFrame:
    """(gram, yes, no) counts over all of ``labelled`` (text, label 0/1); grams of 7 bytes at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            label = np.array(batch.column("label").to_pylist(), dtype=np.uint64)
            for part in N.slices(batch.column("text")):
                yes = np.repeat(label[part.row : part.row + len(part)], np.diff(part.offsets))
                held.append(_grams(codes(part.data), part.offsets, order) << np.uint64(1) | yes)
                size += len(yes)
                if size >= COUNTED:
                    yield _counts(*tally(np.concatenate(held)))
                    held, size = [], 0
        if size:
            yield _counts(*tally(np.concatenate(held)))

    return labelled.select("text", "label").mapInArrow(run, "gram long, yes long, no long").groupBy("gram").agg(F.sum("yes").alias("yes"), F.sum("no").alias("no"))


def tally(marked: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys of ``marked`` (each doubled, plus its label), and how often each has label 1 and 0.  Sorts in place.

    Numbers are sorted themselves, not their places, which is many times as fast.
    """
    marked.sort()
    heads = _heads(marked)
    n, found = np.diff(heads, append=len(marked)), marked[heads]
    keys, yes = found >> np.uint64(1), n * (found & np.uint64(1)).astype(np.int64)
    heads = _heads(keys)
    yes, total = np.add.reduceat(yes, heads), np.add.reduceat(n, heads)
    return keys[heads], yes, total - yes


def _heads(ordered: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin."""
    first = np.ones(len(ordered), dtype=bool)
    np.not_equal(ordered[1:], ordered[:-1], out=first[1:])
    return np.flatnonzero(first)


def _counts(keys: np.ndarray, yes: np.ndarray, no: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(yes), pa.array(no)], ["gram", "yes", "no"])


def _mask(n: int) -> np.uint64:
    return np.uint64((1 << (8 * n)) - 1)


def _fold(grams: np.ndarray, yes: np.ndarray, no: np.ndarray, order: int, shared: int) -> dict[int, tuple]:
    """(keys, yes, no) of each order above ``shared``; below the highest they're continuation counts: kinds of bytes before."""
    levels = {order: (grams, yes.astype(np.float64), no.astype(np.float64))}
    for n in range(order - 1, shared, -1):
        above, y, m = levels[n + 1]
        keys, where = np.unique(above & _mask(n), return_inverse=True)
        levels[n] = keys, np.bincount(where, y > 0, len(keys)), np.bincount(where, m > 0, len(keys))
    return levels


class Totals:
    """What a shard needs to know of all the others: discounts, and pooled probabilities up to ``shared`` bytes (2^24 keys at most)."""

    def __init__(self, order: int, shared: int):
        self.order, self.shared = order, shared
        self.seen = {n: np.zeros((2, 2), dtype=np.int64) for n in range(shared + 1, order + 1)}  # grams of each class counted once, twice
        self.keys, self.kinds = np.zeros(0, dtype=np.uint64), np.zeros(0)

    def add(self, levels: dict[int, tuple]) -> None:
        for n, (_, *counts) in levels.items():
            self.seen[n] += [[np.count_nonzero(c == 1), np.count_nonzero(c == 2)] for c in counts]
        keys, y, m = levels[self.shared + 1]
        every = np.concatenate([self.keys, keys & _mask(self.shared)])
        self.keys, where = np.unique(every, return_inverse=True)
        self.kinds = np.bincount(where, np.concatenate([self.kinds, (y > 0) | (m > 0)]), len(self.keys))

    def discount(self, n: int, c: int) -> float:
        return _discount(*self.seen[n][c])

    def pooled(self) -> tuple[np.ndarray, np.ndarray]:
        """Keys of ``shared`` bytes and their probabilities."""
        levels = {self.shared: (self.keys, self.kinds)}
        for n in range(self.shared - 1, 0, -1):
            above, kinds = levels[n + 1]
            keys, where = np.unique(above & _mask(n), return_inverse=True)
            levels[n] = keys, np.bincount(where, kinds > 0, len(keys))
        below, prob = None, None
        for n in range(1, self.shared + 1):
            keys, kinds = levels[n]
            lower = np.full(len(keys), 1 / 256) if below is None else prob[np.searchsorted(below, keys & _mask(n - 1))]
            contexts, where = np.unique(keys >> np.uint64(8), return_inverse=True)
            prob, _ = _smooth(kinds, where, len(contexts), _discount(np.count_nonzero(kinds == 1), np.count_nonzero(kinds == 2)), lower)
            below = keys
        return below, prob


def _discount(one: int, two: int) -> float:
    return one / (one + 2 * two) if one and two else 0.75


def _smooth(counts: np.ndarray, where: np.ndarray, contexts: int, d: float, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Probability of each gram and backoff weight of each context."""
    total = np.bincount(where, counts, contexts)
    kinds = np.bincount(where, counts > 0, contexts)
    weights = np.where(total > 0, d * kinds / np.maximum(total, 1), 1.0)
    return np.where(total[where] > 0, np.maximum(counts - d, 0) / np.maximum(total[where], 1), 0) + weights[where] * lower, weights


class Shard:
    """From the highest order: keys, their difference, contexts, difference of their backoff weights."""

    def __init__(self, levels: dict[int, tuple], totals: Totals, pooled: tuple[np.ndarray, np.ndarray]):
        self.order, self.levels, self.find = totals.order, [], None
        below, prob = pooled[0], np.stack([pooled[1]] * 2)
        for n in range(totals.shared + 1, totals.order + 1):
            keys, *counts = levels[n]
            contexts, where = np.unique(keys >> np.uint64(8), return_inverse=True)
            lower = prob[:, np.searchsorted(below, keys & _mask(n - 1))]
            prob, weights = (np.stack(x) for x in zip(*(_smooth(counts[c], where, len(contexts), totals.discount(n, c), lower[c]) for c in (0, 1))))
            below = keys
            self.levels.append((keys, np.log(prob[0] / prob[1]).astype(np.float32), contexts, np.log(weights[0] / weights[1]).astype(np.float32)))
        self.levels.reverse()

    def stay(self) -> Shard:
        """With tables for quick lookups in place of the sorted keys."""
        if self.find is None:
            self.find = [(KeyTable(k).find, KeyTable(c).find) for k, _, c, _ in self.levels]
            self.levels = [(None, np.append(d, np.float32(0)), None, np.append(w, np.float32(0))) for _, d, _, w in self.levels]
        return self

    def of(self, keys: np.ndarray) -> np.ndarray:
        """Differences of keys of ``order`` bytes."""
        find = self.find or [(partial(_find, k), partial(_find, c)) for k, _, c, _ in self.levels]
        last = [(d, w) if self.find else (np.append(d, np.float32(0)), np.append(w, np.float32(0))) for _, d, _, w in self.levels]
        out = np.zeros(len(keys), dtype=np.float32)
        at = None  # all
        for i, ((grams, contexts), (difference, weight)) in enumerate(zip(find, last)):
            key = keys if at is None else keys[at] & _mask(self.order - i)
            found = grams(key)
            if at is None:
                out += difference[found]  # 0 where it isn't found
            else:
                out[at] += difference[found]
            miss = np.flatnonzero(found < 0)
            at, key = miss if at is None else at[miss], key[miss]
            if not len(at):
                break
            out[at] += weight[contexts(key >> np.uint64(8))]
        return out


def _find(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Index of each key in sorted ``keys``, -1 for others."""
    at = np.minimum(np.searchsorted(keys, wanted), max(0, len(keys) - 1))
    return np.where(keys[at] == wanted, at, -1) if len(keys) else np.full(len(wanted), -1)


def blocks(parts: Iterator[N.Slice], limit: int) -> Iterator[list[N.Slice]]:
    """Slices, about ``limit`` bytes at a time."""
    held, size = [], 0
    for part in parts:
        held.append(part)
        size += len(part.data)
        if size >= limit:
            yield held
            held, size = [], 0
    if held:
        yield held


def distinct(keys: Iterator[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
    """The distinct keys of all arrays, sorted, and for each array the place of its keys among them."""
    each = [[_ranked(k[i : i + 65536]) for i in range(0, max(1, len(k)), 65536)] for k in keys]
    every = np.sort(np.concatenate([k for some in each for k, _ in some]))
    every = every[_heads(every)]
    return every, [np.concatenate([np.searchsorted(every, k).astype(np.int32)[where] for k, where in some]) for some in each]


def _ranked(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, and the place of each of ``keys`` (65,536 at most) among them; keys of six bytes are sorted together with where they stand."""
    if not len(keys) or int(keys.max()) >> 48:
        found, place = np.unique(keys, return_inverse=True)
        return found, place.astype(np.int32)
    packed = np.sort(keys << np.uint64(16) | np.arange(len(keys), dtype=np.uint64))
    ordered = packed >> np.uint64(16)
    heads, place = _heads(ordered), np.empty(len(keys), dtype=np.int32)
    place[(packed & np.uint64(0xFFFF)).astype(np.int64)] = np.repeat(np.arange(len(heads), dtype=np.int32), np.diff(heads, append=len(keys)))
    return ordered[heads], place


def once(shard):
    """A shard's value; a worker doesn't keep it, so that it holds one shard at a time."""
    if not isinstance(shard, Broadcast):
        return shard
    value = shard.value
    shard.__dict__.pop("_value", None)
    return value


class Model:
    """Differences of log-probability (yes minus no) for ``order`` bytes of context and byte.

    Shards (broadcast where a cluster scores) cover every gram.  All that is looked
    up for a byte has the same ``shared`` bytes before it, and those tell the shard.
    """

    def __init__(self, grams: np.ndarray, yes: np.ndarray, no: np.ndarray, order: int = ORDER, shared: int = SHARED):
        levels, totals = _fold(grams, yes, no, order, shared), Totals(order, shared)
        totals.add(levels)
        self.order, self.shared, self.shards = order, shared, [Shard(levels, totals, totals.pooled())]

    @classmethod
    def of_shards(cls, shards: list, order: int, shared: int) -> Model:
        out = cls.__new__(cls)
        out.order, out.shared, out.shards = order, shared, shards
        return out

    def unpersist(self) -> None:
        for shard in self.shards:
            if isinstance(shard, Broadcast):
                shard.unpersist()

    def shard_of(self, keys: np.ndarray) -> np.ndarray:
        """As ``_shard`` says."""
        context = (keys >> np.uint64(8)) & _mask(self.shared)
        return ((((context * np.uint64(_SPREAD)) & np.uint64(0xFFFFFFFF)) >> np.uint64(8)) % np.uint64(len(self.shards))).astype(np.int64)

    def over(self, parts: Iterator[N.Slice]) -> Iterator[tuple[N.Slice, np.ndarray]]:
        """Each slice with log P(byte | yes) - log P(byte | no) at its bytes."""
        if len(self.shards) == 1:
            shard = (self.shards[0].value if isinstance(self.shards[0], Broadcast) else self.shards[0]).stay()
            for part in parts:
                yield part, shard.of(_grams(codes(part.data), part.offsets, self.order))
            return
        for block in blocks(parts, BLOCK_BYTES):
            keys, places = distinct(_grams(codes(part.data), part.offsets, self.order) for part in block)
            of, out = self.shard_of(keys), np.zeros(len(keys), dtype=np.float32)
            for i, shard in enumerate(self.shards):
                mine = np.flatnonzero(of == i)
                if len(mine):
                    out[mine] = once(shard).of(keys[mine])
            for part, place in zip(block, places):
                yield part, out[place]

    def differences(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """log P(byte | yes) - log P(byte | no) at each byte of texts."""
        return next(self.over(iter([N.Slice(0, data, offsets)])))[1]


def _shard(gram: Column, shared: int, shards: int) -> Column:
    context = F.shiftright(gram, 8).bitwiseAND(F.lit((1 << (8 * shared)) - 1).cast("long"))
    return F.shiftright((context * F.lit(_SPREAD)).bitwiseAND(F.lit(0xFFFFFFFF)), 8) % F.lit(shards)


def train(labelled: DataFrame, order: int = ORDER, shared: int = SHARED, shard_grams: int = SHARD_GRAMS) -> Model:
    """A model of the texts with label 1 against those with label 0, of all their grams.

    The driver makes one shard after another; discounts and the pooled lower orders
    are taken from all of them first, so the number of shards doesn't change a result.
    """
    counts = table(count(labelled, order), "grams")
    shards = max(1, -(-counts.count() // shard_grams))

    def levels(i: int) -> dict[int, tuple]:
        rows = (counts.where(_shard(F.col("gram"), shared, shards) == i) if shards > 1 else counts).toArrow()
        keys = rows.column("gram").to_numpy().view(np.uint64)
        by = np.argsort(keys)
        return _fold(keys[by], rows.column("yes").to_numpy()[by], rows.column("no").to_numpy()[by], order, shared)

    totals, found = Totals(order, shared), None
    for i in range(shards):
        found = levels(i)
        totals.add(found)
    pooled, context = totals.pooled(), labelled.sparkSession.sparkContext
    out = [context.broadcast(Shard(found if shards == 1 else levels(i), totals, pooled)) for i in range(shards)]
    drop(counts)
    return Model.of_shards(out, order, shared)


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, steps: int = 50) -> np.ndarray:
    """Weights (the last is the intercept) of a logistic regression, by Newton's method."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    penalty = np.diag([ridge] * (x.shape[1] - 1) + [1e-9]) * max(1, len(x))
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - y) + penalty @ w
        h = (x * (p * (1 - p) + 1e-9)[:, None]).T @ x + penalty
        step = np.linalg.solve(h, g)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def logistic_over(rows: DataFrame, x: str, y: str, ridge: float = 1e-3, steps: int = 50) -> np.ndarray | None:
    """``logistic`` of one feature over a table of any size, a step an aggregation; None where a class is missing."""
    n, low, high = rows.agg(F.count("*"), F.min(y), F.max(y)).first()
    if not n or low == high:
        return None
    w, penalty = np.zeros(2), np.diag([ridge, 1e-9]) * n
    for _ in range(steps):
        p = 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), F.col(x) * float(w[0]) + float(w[1])))))
        each = rows.select(F.col(x).alias("x"), (p - F.col(y)).alias("e"), (p * (1 - p) + 1e-9).alias("v"))
        gx, g, hxx, hx, h = each.agg(*(F.sum(F.expr(s)) for s in ("e * x", "e", "v * x * x", "v * x", "v"))).first()
        step = np.linalg.solve(np.array([[hxx, hx], [hx, h]]) + penalty, np.array([gx, g]) + penalty @ w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w
