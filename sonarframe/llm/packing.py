"""Best-fit packing of tokenised documents by a grouping genetic algorithm.

Documents become pieces of at most ``CAPACITY`` tokens; only longer documents are
cut.  Full pieces are sequences of their own.  The rest are dealt to demes of
bounded size, and on each deme several islands evolve packings apart: crossover
injects whole well-filled bins of one parent into the other, bins that then hold a
piece twice are emptied, and the displaced pieces go where they fit best.  Between
epochs each island's best packing moves on to the next island.  Bins that are still
not filled are opened again and their pieces dealt to fewer demes, as long as a level
fills bins and more than one deme is left.
"""

from __future__ import annotations

import json
import random
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sonarframe.llm import textnum as N
from sonarframe.llm.shared import drop, id_text, settle, table
from sonarframe.llm.table import KeyTable

CAPACITY, END_ID = 2048, 0
DEME, ISLANDS, EPOCHS, GENERATIONS, POPULATION = 600, 2, 2, 6, 5
#: Free tokens in a bin that counts as filled, by level; what isn't filled is packed again.
FREE = (6, 24)
#: Levels go on while they leave at most this share of their pieces open.
SHRINKS = 0.9
_MARK = b"<|"
#: Distinct words whose tokens a worker keeps.
MAX_WORDS = 1_000_000
#: What a tokenizer must do so that words may be cut at ASCII kinds and encoded many at once.
_PATTERN = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
_NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
#: Letters, digits and other signs of ASCII; 0 for white space and all other bytes.
_KIND = np.array([0 if N.IS_SPACE[b] or b >= 0x80 else 1 if chr(b).isalpha() else 2 if chr(b).isdigit() else 3 for b in range(256)], dtype=np.uint8)
_LETTER = np.array([ord("a") <= b <= ord("z") for b in range(256)])
#: Between words that are encoded together, and how many at most.
_BETWEEN, _TOGETHER = np.frombuffer(b" \0 ", dtype=np.uint8), 4096


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _room(a: np.ndarray, n: int) -> np.ndarray:
    """``a`` with room for ``n`` values at least, growing by halves."""
    return a if n <= len(a) else np.concatenate([a, np.zeros(max(n, 3 * len(a) // 2) - len(a), dtype=a.dtype)])


class Encoder:
    """Token ids of whole texts, word by word.

    The tokenizer drops white space and never joins what it separates, so a text's
    ids are its words' ids; the tokens of words seen before are kept in flat arrays.
    Words of up to seven bytes are their own key.  Longer ones are found by hash and
    their bytes compared with the word's that was kept; what differs, and words over
    ``textnum.LONG_WORD`` bytes, are tokenised each time.

    A tokenizer of the known pattern always cuts where ASCII letters, digits and other
    signs meet, so its words are what lies between: far fewer are distinct.
    """

    def __init__(self, path: str, weaken: int = 0):
        from tokenizers import Tokenizer

        self.tokenizer, self.weaken = Tokenizer.from_file(path), weaken
        self.between = self._mark() if self._known() else None
        self._clear()

    def _known(self) -> bool:
        """Whether the tokenizer splits by ``_PATTERN`` after ``_NORMALIZERS``, and its special tokens begin with ``_MARK``."""
        state = [json.loads(x.__getstate__()) if x is not None else {} for x in (self.tokenizer.pre_tokenizer, self.tokenizer.normalizer)]
        first, *rest = state[0].get("pretokenizers", [{}])
        split = first.get("type") == "Split" and first.get("pattern") == {"Regex": _PATTERN} and first.get("behavior") == "Removed" and first.get("invert")
        byte_level = [r.get("type") for r in rest] == ["ByteLevel"] and not rest[0]["add_prefix_space"] and not rest[0]["use_regex"]
        special = all(t.content.startswith(_MARK.decode()) for t in self.tokenizer.get_added_tokens_decoder().values())
        return bool(split and byte_level and state[1].get("normalizers") == _NORMALIZERS and special)

    def _mark(self) -> int | None:
        """The id that NUL alone has, which no text without a NUL has."""
        ids = self.tokenizer.encode("\0", add_special_tokens=False).ids
        return ids[0] if len(ids) == 1 else None

    def _clear(self):
        self.table = KeyTable(np.zeros(0, np.uint64))
        self.at, self.size, self.flat, self.used = np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0, np.uint32), 0
        self.word_at, self.word_size, self.words, self.written = np.zeros(0, np.int32), np.zeros(0, np.uint8), np.zeros(8, np.uint8), 0

    def _keys(self, part: N.Slice) -> np.ndarray:
        size = part.ends - part.starts
        hashes = part.word_hashes()
        if self.weaken:
            hashes %= np.uint64(self.weaken)
        own = N.eights(part.data)[part.starts] & N.LOW_BYTES[np.minimum(size, 7)] | size.astype(np.uint64) << np.uint64(56)
        return np.where(size <= 7, own, hashes | np.uint64(0xFF << 56))

    def _tokens(self, part: N.Slice, where: np.ndarray) -> tuple[np.ndarray, list[int]]:
        """Numbers of tokens of the words at ``where``, and the tokens."""
        if self.between is not None and len(where) and not (part.data == 0).any():
            size = part.ends[where] - part.starts[where]
            plain = np.logical_and.reduceat(_LETTER[part.data[N.ranges(part.starts[where], size)]], np.cumsum(size) - size)
            kinds = [np.flatnonzero(plain), np.flatnonzero(~plain)]
            found = [(at, run(part, where[at])) for k, run in zip(kinds, (self._letters, self._together)) for at in np.split(k, range(_TOGETHER, len(k), _TOGETHER)) if len(at)]
            size[np.concatenate([at for at, _ in found])] = np.concatenate([n for _, (n, _) in found])
            tokens, heads = np.empty(int(size.sum()), dtype=np.uint32), np.cumsum(size) - size
            for at, (n, some) in found:
                tokens[N.ranges(heads[at], n)] = some
            return size, tokens
        words = [part.data[s:e].tobytes().decode("utf-8", "replace") for s, e in zip(part.starts[where].tolist(), part.ends[where].tolist())]
        ids = [e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
        return np.array([len(i) for i in ids], dtype=np.int64), np.array([t for i in ids for t in i], dtype=np.uint32)

    def _letters(self, part: N.Slice, where: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """As ``_tokens``, for words of a to z alone: they are normal already, and one word to the tokenizer's model."""
        words = _joined(part, where, _BETWEEN[:1]).tobytes().decode().split()
        tokenize = self.tokenizer.model.tokenize
        ids = [[t.id for t in tokenize(w)] for w in words]
        return np.array([len(i) for i in ids], dtype=np.int64), np.array([t for i in ids for t in i], dtype=np.uint32)

    def _together(self, part: N.Slice, where: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """As ``_tokens``, as one text: white space separates, and a NUL after each word tells where it ends."""
        text = _joined(part, where, _BETWEEN)
        ids = np.array(self.tokenizer.encode_batch_fast([text.tobytes().decode("utf-8", "replace")], add_special_tokens=False)[0].ids, dtype=np.uint32)
        ends = np.flatnonzero(ids == self.between)
        return np.diff(ends, prepend=-1) - 1, ids[ids != self.between]

    def _put(self, n: int, size: np.ndarray, tokens: np.ndarray) -> None:
        """Tokens of words numbered from ``n`` on."""
        total = len(tokens)
        self.at, self.size, self.flat = _room(self.at, n + len(size)), _room(self.size, n + len(size)), _room(self.flat, self.used + total)
        self.at[n : n + len(size)] = self.used + np.cumsum(size) - size
        self.size[n : n + len(size)] = size
        self.flat[self.used : self.used + total] = tokens

    def _learn(self, part: N.Slice, keys: np.ndarray, missing: np.ndarray) -> None:
        new, first = np.unique(keys[missing], return_index=True)
        where = missing[first]
        if self.table.n + len(new) > MAX_WORDS:
            self._clear()
            brief = np.flatnonzero(part.ends - part.starts <= N.LONG_WORD)
            new, first = np.unique(keys[brief], return_index=True)
            where = brief[first]
        n, (size, tokens) = self.table.n, self._tokens(part, where)
        self._put(n, size, tokens)
        self.used += len(tokens)
        starts, length = part.starts[where], part.ends[where] - part.starts[where]
        length = np.where(length > 7, length, 0)  # shorter words are told by their keys
        self.word_at, self.word_size = _room(self.word_at, n + len(new)), _room(self.word_size, n + len(new))
        self.words = _room(self.words, self.written + int(length.sum()) + 8)
        self.word_at[n : n + len(new)], self.word_size[n : n + len(new)] = self.written + np.cumsum(length) - length, length
        self.words[self.written : self.written + int(length.sum())] = part.data[N.ranges(starts, length)]
        self.written += int(length.sum())
        self.table.add(new)

    def ids(self, part: N.Slice) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts of a slice, each text followed by END_ID; offsets of texts)."""
        if self.between is not None:
            part = _cut(part)
        keys, length = self._keys(part), part.ends - part.starts
        index, brief = self.table.find(keys), length <= N.LONG_WORD
        missing = np.flatnonzero((index < 0) & brief)
        if len(missing):
            self._learn(part, keys, missing)
            index = self.table.find(keys)
        alone, hashed = ~brief, np.flatnonzero(brief & (length > 7))
        if len(hashed):
            alone[hashed] = self.word_size[index[hashed]] != length[hashed]
            hashed = hashed[~alone[hashed]]
            kept = np.ndarray((len(self.words) - 7,), dtype="<u8", buffer=self.words, strides=(1,))
            alone[hashed] = ~N.same_bytes(N.eights(part.data), part.starts[hashed], kept, self.word_at[index[hashed]].astype(np.int64), length[hashed])
        direct = np.flatnonzero(alone)
        if len(direct):
            size, tokens = self._tokens(part, direct)
            self._put(self.table.n, size, tokens)  # written over by the next
            index[direct] = self.table.n + np.arange(len(direct))
        size = self.size[index].astype(np.int64)
        ends = np.concatenate([[0], np.cumsum(size)])[part.word_offsets[1:]]
        ids = self.flat[N.ranges(self.at[index].astype(np.int64), size)]
        return np.insert(ids, ends, END_ID), np.concatenate([[0], ends + np.arange(1, len(ends) + 1)])


def _joined(part: N.Slice, where: np.ndarray, between: np.ndarray) -> np.ndarray:
    """The bytes of words, ``between`` after each."""
    size, gap = part.ends[where] - part.starts[where], len(between)
    heads = np.cumsum(size + gap) - (size + gap)
    text = np.empty(int((size + gap).sum()), dtype=np.uint8)
    text[N.ranges(heads, size)] = part.data[N.ranges(part.starts[where], size)]
    for i, b in enumerate(between.tolist()):
        text[heads + size + i] = b
    return text


def _marks(data: np.ndarray) -> np.ndarray:
    return (data[:-1] == _MARK[0]) & (data[1:] == _MARK[1])


def _words_at(part: N.Slice, marked: np.ndarray) -> np.ndarray:
    """Numbers of the words with a marked byte (none of them white space)."""
    of = np.searchsorted(part.starts, np.flatnonzero(marked), side="right") - 1
    return of[np.diff(of, prepend=-1) > 0]


def _cut(part: N.Slice) -> N.Slice:
    """The slice with its words cut where ASCII letters, digits and other signs meet.

    Both bytes of a cut are ASCII, so nothing is composed across it.  Words with an apostrophe, which may begin a
    contraction, and words that may hold a special token stay whole.
    """
    kind = _KIND[part.data]
    at = np.flatnonzero((kind[1:] != kind[:-1]) & (kind[1:] > 0) & (kind[:-1] > 0)) + 1
    whole = np.zeros(len(part.starts) + 1, dtype=bool)
    odd = part.data == ord("'")
    odd[:-1] |= _marks(part.data)
    whole[_words_at(part, odd)] = True
    at = at[~whole[np.searchsorted(part.starts, at, side="right") - 1]]
    first, last = np.zeros((2, len(part.data) + 1), dtype=bool)
    first[part.starts] = first[at] = last[part.ends] = last[at] = True
    starts = np.flatnonzero(first)
    out = N.Slice(part.row, part.data, part.offsets)
    out._words = starts, np.flatnonzero(last), np.searchsorted(starts, part.offsets)
    return out


def _folded(part: N.Slice) -> np.ndarray:
    """The slice's bytes with A-Z lower-cased in words of ASCII letters alone that can't hold a special token.

    The tokenizer composes characters first and lower-cases then, and a capital may
    have no composed form where the small letter has one; so other words stay.
    """
    odd = part.data >= 0x80
    odd[:-1] |= _marks(part.data)
    words = _words_at(part, odd)
    kept = N.ranges(part.starts[words], part.ends[words] - part.starts[words])
    out = N.LOWER[part.data]
    out[kept] = part.data[kept]
    return out


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The process's encoder for a tokenizer: what it has learned serves the worker's next tasks too."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path if Path(path).exists() else default_tokenizer())
    return _ENCODERS[path]


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, ids array<int>"


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, capacity: int = CAPACITY, with_ids: bool = True) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and (``with_ids``) the ids of each piece; a null text is empty."""
    path = tokenizer or default_tokenizer()
    settle(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = encoder(path)
        for batch in batches:
            docs = batch.column("doc_id")
            for part in N.slices(batch.column("text")):
                part.data = _folded(part)
                ids, offsets = known.ids(part)
                total = np.diff(offsets)
                count = -(-total // capacity)
                doc = np.repeat(np.arange(len(part)), count)
                number = N.ranges(np.zeros(len(count), dtype=np.int64), count)
                start = number * capacity
                length = np.minimum(capacity, total[doc] - start)
                at = offsets[doc] + start
                raw = ids.astype("<u4")
                found = [raw[a : a + n] for a, n in zip(at.tolist(), length.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [docs.take(pa.array(part.row + doc)), pa.array(number.astype(np.int32)), pa.array(start), pa.array(length), pa.array([zlib.crc32(f.tobytes()) for f in found], pa.int64()), pa.array([f.astype(np.int32) for f in found] if with_ids else [None] * len(found), pa.list_(pa.int32()))],
                    ["doc_id", "piece", "start", "length", "ids_crc32", "ids"],
                )

    out = id_text(docs, id_col, text_col).mapInArrow(run, PIECES)
    return out if with_ids else out.drop("ids")


class Packing:
    """One individual: bins of item numbers, with their fills."""

    def __init__(self, bins: list[list[int]], fills: list[int]):
        self.bins, self.fills = bins, fills

    def fitness(self, capacity: int) -> float:
        return sum((f / capacity) ** 2 for f in self.fills) / max(1, len(self.fills)) - len(self.fills)


def best_fit(items: list[int], lengths: list[int], packing: Packing, capacity: int) -> Packing:
    """Put ``items``, the longest first, into the fullest bin that takes them, or a new one."""
    bins, fills = packing.bins, packing.fills
    free = sorted((capacity - f, b) for b, f in enumerate(fills) if f < capacity)
    for i in items:
        n = lengths[i]
        k = bisect_left(free, (n, -1))
        if k < len(free):
            room, b = free.pop(k)
            bins[b].append(i)
            fills[b] += n
        else:
            room, b = capacity, len(bins)
            bins.append([i])
            fills.append(n)
        if room > n:
            insort(free, (room - n, b))
    return packing


def crossover(one: Packing, other: Packing, lengths: list[int], capacity: int, rng: random.Random) -> Packing:
    """``one`` with well-filled bins of ``other`` injected; what they displace goes where it fits best."""
    by_fill = sorted(range(len(other.bins)), key=lambda b: -other.fills[b])
    best = by_fill[: max(1, len(by_fill) // 2)]
    chosen = rng.sample(best, max(1, len(best) // 3))
    taken = {i for b in chosen for i in other.bins[b]}
    bins, fills, displaced = [list(other.bins[b]) for b in chosen], [other.fills[b] for b in chosen], []
    for b, f in zip(one.bins, one.fills):
        if taken.isdisjoint(b):
            bins.append(list(b))
            fills.append(f)
        else:
            displaced.extend(i for i in b if i not in taken)
    displaced.sort(key=lambda i: -lengths[i])
    return best_fit(displaced, lengths, Packing(bins, fills), capacity)


def mutate(packing: Packing, lengths: list[int], capacity: int, rng: random.Random) -> Packing:
    """Empty the least filled bins and a few others, and put their pieces back in a slightly shuffled order."""
    by_fill = sorted(range(len(packing.bins)), key=lambda b: packing.fills[b])
    gone = set(by_fill[: max(1, len(by_fill) // 12)]) | set(rng.sample(by_fill, max(1, len(by_fill) // 25)))
    displaced = sorted((i for b in gone for i in packing.bins[b]), key=lambda i: -lengths[i] * (1 + 0.2 * rng.random()))
    rest = [b for b in range(len(packing.bins)) if b not in gone]
    return best_fit(displaced, lengths, Packing([list(packing.bins[b]) for b in rest], [packing.fills[b] for b in rest]), capacity)


def evolve(lengths: list[int], seeds: list[Packing], capacity: int, rng: random.Random, generations: int = GENERATIONS, population: int = POPULATION) -> Packing:
    """The best packing after some generations, starting from ``seeds``, best-fit decreasing and shuffled orders."""
    floor = -(-sum(lengths) // capacity)
    order = sorted(range(len(lengths)), key=lambda i: -lengths[i])
    people = list(seeds) or [best_fit(order, lengths, Packing([], []), capacity)]
    while len(people) < population:
        noisy = sorted(order, key=lambda i: -lengths[i] * (1 + 0.3 * rng.random()))
        people.append(best_fit(noisy, lengths, Packing([], []), capacity))
    people.sort(key=lambda p: -p.fitness(capacity))
    for _ in range(generations):
        if len(people[0].bins) <= floor:
            break
        one, other = rng.sample(people[: max(2, population // 2 + 1)], 2)
        children = [crossover(one, other, lengths, capacity, rng), crossover(other, one, lengths, capacity, rng), mutate(people[0], lengths, capacity, rng)]
        people = sorted(people + children, key=lambda p: -p.fitness(capacity))[:population]
    return people[0]


_EVOLVED = "deme long, island int, uid long, length long, bin int"


def _evolve_group(epoch: int, capacity: int, islands: int):
    def run(key, rows):
        deme, island = key[0].as_py(), key[1].as_py()
        frame = rows.select(["uid", "length", "source", "bin"]).to_pandas().sort_values(["source", "uid"], kind="stable")
        first = frame[frame.source == frame.source.min()]
        uids, lengths = first.uid.to_numpy(), first.length.tolist()
        seeds = []
        for _, solution in frame[frame.bin >= 0].groupby("source", sort=True):
            bins: dict[int, list[int]] = {}
            for i, b in enumerate(solution.bin):
                bins.setdefault(b, []).append(i)
            seeds.append(Packing(list(bins.values()), [sum(lengths[i] for i in b) for b in bins.values()]))
        best = evolve(lengths, seeds, capacity, random.Random(f"{deme}/{island}/{epoch}"))
        of = np.empty(len(lengths), dtype=np.int32)
        for b, items in enumerate(best.bins):
            of[items] = b
        n = len(lengths)
        return pa.table({"deme": pa.array([deme] * n, pa.int64()), "island": pa.array([island] * n, pa.int32()), "uid": uids, "length": pa.array(lengths, pa.int64()), "bin": of})

    return run


def _choose(capacity: int, free: int):
    """Of the islands' packings of a deme the one with the fewest bins; bins with more than ``free`` tokens left are opened."""

    def run(key, rows):
        frame = rows.to_pandas().sort_values(["island", "bin", "uid"], kind="stable")
        least = min(frame.groupby("island"), key=lambda g: (g[1].bin.nunique(), -float((g[1].groupby("bin").length.sum() ** 2).sum()), g[0]))[1].copy()
        least["offset"] = least.groupby("bin").length.cumsum() - least.length
        least["full"] = least.groupby("bin").length.transform("sum") >= capacity - free
        return pa.table({"deme": pa.array(least.deme, pa.int64()), "uid": pa.array(least.uid, pa.int64()), "length": pa.array(least.length, pa.int64()), "bin": pa.array(least.bin, pa.int32()), "offset": pa.array(least.offset, pa.int64()), "full": pa.array(least.full, pa.bool_())})

    return run


def assign(items: DataFrame, capacity: int = CAPACITY, deme: int = DEME, islands: int = ISLANDS, epochs: int = EPOCHS, free: tuple[int, ...] = FREE) -> DataFrame:
    """uid, sequence_id, offset for items (uid, length <= capacity), in as few sequences as can be found."""
    done, level, before = [], 0, None
    while True:
        n = items.count()
        demes = -(-n // deme) if level < len(free) else max(1, -(-n // (4 * deme)))
        last = demes <= 1 or (level > len(free) and n > SHRINKS * before)  # the level before left nearly all open
        before = n
        now = items.select(F.pmod(F.xxhash64("uid", F.lit(level)), F.lit(max(1, demes))).alias("deme"), F.explode(F.array(*(F.lit(i) for i in range(islands)))).alias("island"), "uid", "length", F.lit(0).alias("source"), F.lit(-1).alias("bin"))
        for epoch in range(epochs):
            best = table(now.groupBy("deme", "island").applyInArrow(_evolve_group(epoch, capacity, islands), _EVOLVED), "islands")
            if epoch:
                drop(previous)
            previous = best
            moved = best.withColumn("island", ((F.col("island") + 1) % islands).cast("int"))
            now = best.withColumn("source", F.lit(0)).unionByName(moved.withColumn("source", F.lit(1)))
        chosen = table(best.groupBy("deme").applyInArrow(_choose(capacity, capacity if last else free[min(level, len(free) - 1)]), "deme long, uid long, length long, bin int, offset long, full boolean"), "packed")
        drop(best)
        done.append(chosen.where("full").select("uid", (((F.lit(level + 1).cast("long") * (1 << 40)) + F.col("deme")) * 65536 + F.col("bin")).alias("sequence_id"), "offset"))
        items = chosen.where("not full").select("uid", "length")
        level += 1
        if last:
            break
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids) of every piece of every row.

    A null or empty text is one piece with the end id alone; a row with a null id is packed like others.  Repeated rows are packed
    each for itself.  An empty table gives no rows.
    """
    cut = table(pieces(docs, id_col, text_col, tokenizer, capacity, with_ids).withColumn("uid", F.monotonically_increasing_id()), "pieces")
    full = cut.where(F.col("length") == capacity).select("uid", F.col("uid").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    full = full.withColumn("sequence_id", -F.col("sequence_id") - 1)
    placed = full.unionByName(assign(cut.where(F.col("length") < capacity).select("uid", "length"), capacity))
    return cut.join(placed, "uid").drop("uid")
