"""Benchmark passages in documents, by the q-gram lemma and banded alignment.

A passage of m characters that occurs with at most k edits shares at least
m - q + 1 - k*q of its q-grams with the text, on diagonals no further than k apart.
For each benchmark item shared q-grams are counted in overlapping bands of diagonals,
each twice k + 1 wide, so any such passage lies in one band whole; bands that
reach the bound are aligned, inside their diagonals only.

With ``region`` the same holds for parts of an item: it's also looked for by windows
of that many characters, ``STRIDE`` apart and one at its end, each with the budget of
its own length.  So any region + STRIDE - 1 consecutive characters of an item that a
document holds verbatim have a whole window in them.  Items too short for edits to
tell them from chance are then looked for verbatim, at word boundaries.

The benchmark is the query set: it's taken in blocks of bounded size, each
broadcast against all documents, which are read once.  A worker holds one block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sonarframe.llm import textnum as N
from sonarframe.llm.kneser_ney import once
from sonarframe.llm.shared import id_text, named, settle, without
from sonarframe.llm.table import KeyTable

Q, EDIT_RATE = 10, 0.06
#: Items with fewer characters, after normalisation, can't be told from chance with edits: they match verbatim or not at all.
LEAST_CHARS = 30
#: Characters of a region, and how far apart regions of an item begin.
REGION, STRIDE = 50, 11
#: Characters of benchmark items that are broadcast at once.
BLOCK_CHARS = 500_000
#: Characters and documents of text that are searched at once, and bands that text positions are expanded to at once: a
#: slice's arrays stay below the size from which the workers' memory is given back (shared.WORKER), which costs time.
SLICE_CHARS, SLICE_DOCS, MOST_EXPANDED = 1 << 14, 1 << 12, 1 << 20


def normalise(text: str) -> str:
    """Lower case, and runs of white space as one space."""
    return " ".join(text.lower().split())


def budget(chars: int, rate: float = EDIT_RATE, q: int = Q) -> int:
    """Edits allowed in an item: at the rate, but so few that the lemma still asks for a shared q-gram."""
    return max(0, min(int(rate * chars), (chars - q) // q))


def align(pattern: np.ndarray, text: np.ndarray, low: int, high: int, most: int) -> tuple[int, int] | None:
    """(edits, end) of the best occurrence of ``pattern`` in ``text`` on diagonals low..high, or None beyond ``most``.

    Row i of the table holds text positions i + low .. i + high; an occurrence may
    begin and end on any diagonal of the band.
    """
    width = high - low + 1
    far = np.int32(1 << 20)
    steps = np.arange(width, dtype=np.int32)
    positions = steps + low
    row = np.where((positions >= 0) & (positions <= len(text)), 0, far).astype(np.int32)
    padded = np.concatenate([text, np.zeros(1, text.dtype)])
    for i, c in enumerate(pattern):
        at = positions + i  # text characters that a diagonal step consumes
        inside = (at >= 0) & (at < len(text))
        step = row + (~inside | (padded[np.where(inside, at, len(text))] != c))
        step = np.where(inside, step, far)
        gone = np.append(row[1:], far) + 1  # a character of the pattern that the text lacks
        row = np.minimum(step, gone)
        valid = (positions + i + 1 >= 0) & (positions + i + 1 <= len(text))
        row = np.where(valid, row, far).astype(np.int32)
        row = (np.minimum.accumulate(row - steps) + steps).astype(np.int32)  # extra characters of the text
        row = np.where(valid, row, far)
        if row.min() > most:
            return None
    best = int(row.argmin())
    return (int(row[best]), best + low + len(pattern)) if row[best] <= most else None


class Items:
    """One block of benchmark items with the index of their q-grams.

    Places of a q-gram in a pattern that are nearer to each other than a band is wide
    are one run: what a text's q-gram meets is a range of diagonals, so that a line of
    one character costs a few bands and not its square.
    """

    def __init__(self, items: list[tuple[int, str]], rate: float = EDIT_RATE, q: int = Q, region: int | None = None):
        self.q = q
        whole = [(i, points(t)) for i, t in ((i, normalise(t)) for i, t in items) if t]
        least = max(LEAST_CHARS, q)
        patterns = [(i, t) for i, t in whole if len(t) >= least]
        n = len(patterns)
        if region:
            seen: set[tuple[int, bytes]] = set()
            for i, t in patterns[:n]:
                for at in sorted({*range(0, len(t) - region, STRIDE), len(t) - region}) if len(t) > region else ():
                    part = t[at : at + region]
                    if (i, part.tobytes()) not in seen:
                        seen.add((i, part.tobytes()))
                        patterns.append((i, part))
        self.whole = np.arange(len(patterns)) < n
        self.ids, self.texts = [i for i, _ in patterns], [t for _, t in patterns]
        self.owner = np.unique(np.array(self.ids, dtype=np.int64), return_inverse=True)[1]  # patterns of one item have one number
        self.short = Short([(i, t) for i, t in whole if len(t) < least] if region else [])
        self.lengths = np.array([len(t) for t in self.texts], dtype=np.int64)
        self.budgets = np.array([budget(n, rate, q) for n in self.lengths], dtype=np.int64)
        self.least = self.lengths - q + 1 - self.budgets * q
        grams = [gram_hashes(t, q) for t in self.texts]
        item = np.repeat(np.arange(len(grams)), [len(g) for g in grams])
        place = np.concatenate([np.arange(len(g)) for g in grams]) if grams else np.zeros(0, dtype=np.int64)
        every = np.concatenate(grams) if grams else np.zeros(0, dtype=np.uint64)
        by = np.lexsort((place, item, every))
        every, item, place = every[by], item[by], place[by]
        new = np.ones(len(every), dtype=bool)
        new[1:] = (every[1:] != every[:-1]) | (item[1:] != item[:-1]) | (np.diff(place) > self.budgets[item[1:]])
        heads = np.flatnonzero(new)
        self.item, self.low = item[heads], place[heads]
        self.high = place[np.append(heads[1:], len(place)) - 1] if len(heads) else self.low
        self.keys, self.first, self.count = np.unique(every[heads], return_index=True, return_counts=True)
        spread = (self.high - self.low) // (self.budgets[self.item] + 1) + 3
        self.weight = np.add.reduceat(spread, self.first) if len(self.first) else spread
        self.bits = np.zeros(1 << 22, dtype=bool)
        self.bits[(self.keys & np.uint64(self.bits.size - 1)).astype(np.int64)] = True
        self.table = KeyTable(self.keys)

    def _bands(self, at: np.ndarray, found: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Keys of (document, pattern, band) that text positions meet, and how many do."""
        times = self.count[found]
        entry = N.ranges(self.first[found], times)
        item, place = self.item[entry], np.repeat(at, times)
        step = self.budgets[item] + 1
        # each diagonal counts in its band and in the one before
        low = (place - self.high[entry]) // step - 1
        each = (place - self.low[entry]) // step - low + 1
        lead = np.repeat(owner[place] * len(self.ids) + item, each)
        return np.unique((lead << 31) + N.ranges(low, each) + (1 << 30), return_counts=True)

    def search(self, text: np.ndarray, owner: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        """(document, item, edits, end) for occurrences in ``text``, whose documents ``owner`` tells."""
        hashes = gram_hashes(text, self.q)
        at = np.flatnonzero(self.bits[(hashes & np.uint64(self.bits.size - 1)).astype(np.int64)])
        found = self.table.find(hashes[at])
        at, found = at[found >= 0], found[found >= 0]
        if not len(at):
            return
        # some positions at a time, by what they expand to
        cost = np.cumsum(self.weight[found])
        cuts = np.searchsorted(cost, np.arange(MOST_EXPANDED, int(cost[-1]) + MOST_EXPANDED, MOST_EXPANDED))
        each = [self._bands(at[a:b], found[a:b], owner) for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(at)]) if a < b]
        if len(each) == 1:
            keys, n = each[0]
        else:
            keys, where = np.unique(np.concatenate([k for k, _ in each]), return_inverse=True)
            n = np.bincount(where, np.concatenate([c for _, c in each]), len(keys)).astype(np.int64)
        lead, band = keys >> 31, (keys & ((1 << 31) - 1)) - (1 << 30)
        keep = n >= np.maximum(self.least[lead % len(self.ids)], 1)
        lead, band, n = lead[keep], band[keep], n[keep]
        seen: set[int] = set()
        for i in np.lexsort((-n, ~self.whole[lead % len(self.ids)])).tolist():  # whole items first, then the fullest band
            d, k = divmod(int(lead[i]), len(self.ids))
            pair = d * len(self.ids) + int(self.owner[k])
            if pair in seen:
                continue
            most, m = int(self.budgets[k]), int(self.lengths[k])
            low = int(band[i]) * (most + 1)
            begin, end = np.searchsorted(owner, d), np.searchsorted(owner, d, side="right")
            from_, to = max(begin, low - most), min(end, low + 2 * most + 2 + m + most)
            got = align(self.texts[k], text[from_:to], low - int(from_), low + 2 * most + 1 - int(from_), most)
            if got:
                seen.add(pair)
                yield d, k, got[0], int(from_) + got[1] - int(begin)


class Short:
    """Items of few characters, found where a text has all of them and no letter or digit goes on before or after."""

    def __init__(self, items: list[tuple[int, np.ndarray]]):
        by: dict[int, list[tuple[int, np.ndarray]]] = {}
        for i, t in items:
            by.setdefault(len(t), []).append((i, t))
        self.lengths = []  # length, distinct hashes, items of each
        for m, same in sorted(by.items()):
            keys, where = np.unique(np.concatenate([gram_hashes(t, m) for _, t in same]), return_inverse=True)
            groups: list[list[tuple[int, np.ndarray]]] = [[] for _ in keys]
            for g, item in zip(where.tolist(), same):
                groups[g].append(item)
            self.lengths.append((m, keys, groups))

    def search(self, text: np.ndarray, owner: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(document, item's identifier, end) once for a document and an item."""
        seen: set[tuple[int, int]] = set()
        for m, keys, groups in self.lengths:
            hashes = gram_hashes(text, m)
            for at in np.flatnonzero(np.isin(hashes, keys)).tolist():
                d = int(owner[at])
                for i, t in groups[int(np.searchsorted(keys, hashes[at]))]:
                    if (d, i) not in seen and np.array_equal(text[at : at + m], t) and not _goes_on(text, at) and not _goes_on(text, at + m):
                        seen.add((d, i))
                        yield d, i, at + m - int(np.searchsorted(owner, d))


def _goes_on(text: np.ndarray, at: int) -> bool:
    """Whether a word goes on from the character before ``at`` to the one there."""
    return 0 < at < len(text) and chr(text[at - 1]).isalnum() and chr(text[at]).isalnum()


def points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def gram_hashes(text: np.ndarray, q: int) -> np.ndarray:
    return N.runs(N.mix(text.astype(np.uint64) + np.uint64(1)), q)


FOUND = "doc_id long, item_id long, contaminated boolean, edits int, passage_end long, similarity double"


def passages(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", edit_rate: float = EDIT_RATE, q: int = Q, region: int | None = None) -> DataFrame:
    """One row for each document and benchmark item that it contains with at most ``edit_rate`` edits a character.

    doc_id, item_id, contaminated (true), edits, passage_end (in the normalised text)
    and similarity (1 - edits / characters of the item).  With ``region`` a document also
    contains an item if it has a region of that many characters; edits and similarity are
    the region's unless the whole item is found, and items under LEAST_CHARS characters
    are found verbatim (without ``region`` they're in nothing).  Null and empty texts
    contain nothing; null and blank items are in nothing; an empty benchmark or table of documents gives no rows.  A pair is given once per row of ``docs``;
    rows with a null id are searched too, and come out with it.  A very long text is normalised and searched whole, in one slice.
    """
    source, spark = id_text(docs, id_col, text_col).where("text is not null"), docs.sparkSession
    settle(spark)
    blocks: list[Broadcast] = []
    held: list[tuple[int, str]] = []
    size = 0
    for item in benchmark.select(named(item_col).cast("long").alias("i"), named(item_text_col).cast("string").alias("t")).where("i is not null and t is not null").toLocalIterator():
        held.append((item.i, item.t))
        size += len(item.t)
        if size >= BLOCK_CHARS:
            blocks.append(spark.sparkContext.broadcast(Items(held, edit_rate, q, region)))
            held, size = [], 0
    if held:
        blocks.append(spark.sparkContext.broadcast(Items(held, edit_rate, q, region)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            parts = _slices(batch.column("text"))
            if len(blocks) != 1:
                parts = list(parts)  # searched by one block after another
            for block in blocks:
                known, rows = block.value if len(blocks) == 1 else once(block), []
                for first, owner, text in parts:
                    rows += [(ids[first + d], i, True, 0, end, 1.0) for d, i, end in known.short.search(text, owner)]
                    if known.ids:
                        rows += [(ids[first + d], known.ids[k], True, edits, end, 1 - edits / int(known.lengths[k])) for d, k, edits, end in known.search(text, owner)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.bool_(), pa.int32(), pa.int64(), pa.float64()))], ["doc_id", "item_id", "contaminated", "edits", "passage_end", "similarity"])

    return source.mapInArrow(run, FOUND)


def _slices(column) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """First row, document of each character, characters of some normalised texts, each with a line's end after it."""
    parts, size, first = [], 0, 0
    for row in range(len(column)):
        parts.append(normalise(column[row].as_py()) + "\n")
        size += len(parts[-1])
        if size >= SLICE_CHARS or len(parts) == SLICE_DOCS or row == len(column) - 1:
            yield first, np.repeat(np.arange(len(parts)), [len(p) for p in parts]), points("".join(parts))
            parts, size, first = [], 0, row + 1


def keep_clean(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of ``docs`` that contain no benchmark item and no region of one, with all their columns.

    Rows with a null id stay, and so do null and empty texts; rows that share an id go together.  An empty table stays
    empty, an empty benchmark leaves all rows.  Very long texts are searched whole.
    """
    gone = passages(docs, benchmark, id_col, text_col, region=REGION).select("doc_id").distinct()
    return without(docs, gone, id_col)
