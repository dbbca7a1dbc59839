"""Alignment of the tokens of two tokenizers by byte-owner arrays.

Every byte of a text has an owner in each tokenizer: the token that holds it
(``np.repeat`` of token numbers over bytes).  Consecutive distinct pairs of owners are
the overlaps of tokens; where both owners change at once is a cut, at which a token of
each ends.  Cuts divide both token sequences into groups, and the two tokens that end
at a cut are a link.

Both tokenizers always cut before a space that follows another character than white
space, so texts are aligned stretch by stretch between such places, and what was found
for a stretch is kept by the worker.  ``Aligner`` refuses a piece vocabulary that has
pieces across such a place.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sonarframe.llm import textnum as N
from sonarframe.llm.shared import drop, id_text, settle, table

#: Where a text is cut into stretches (the space begins the next one).
_STRETCH = re.compile(r"(?<=\S) (?!\Z)")
#: Distinct stretches a worker keeps, and the longest that is kept.
MAX_KEPT, LONG = 500_000, 200
#: Pairs of ids whose counts are broadcast (12 bytes each); more are joined.
MOST_PAIRS = 1 << 22


def default_tokenizers() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def byte_symbols() -> dict[str, int]:
    """The byte behind each symbol of a byte-level vocabulary: printable Latin-1 stands for itself, the rest follows from U+0100 on."""
    own = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b <= 0xFF]
    moved = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(moved)}


def owners(sizes: np.ndarray) -> np.ndarray:
    """The number of the token that holds each byte."""
    return np.repeat(np.arange(len(sizes)), sizes)


def align(size_a: np.ndarray, size_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(owners of A and of B in every overlap of tokens, in order; whether the overlap ends at a cut), for bytes of equal number."""
    own_a, own_b = owners(size_a), owners(size_b)
    if not len(own_a):
        return own_a, own_b, np.zeros(0, dtype=bool)
    new_a, new_b = np.ones(len(own_a) + 1, dtype=bool), np.ones(len(own_b) + 1, dtype=bool)
    new_a[1:-1], new_b[1:-1] = own_a[1:] != own_a[:-1], own_b[1:] != own_b[:-1]
    last = np.flatnonzero((new_a | new_b)[1:])  # of each overlap, its last byte
    return own_a[last], own_b[last], (new_a & new_b)[1:][last]


class Aligner:
    """Tokens, groups and links of stretches of text."""

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        byte_of = byte_symbols()
        symbols = sorted((i, t) for t, i in self.a.get_vocab(with_added_tokens=True).items())
        self.bytes_a = [b""] * (symbols[-1][0] + 1)
        for i, t in symbols:
            self.bytes_a[i] = bytes(byte_of[c] for c in t) if all(c in byte_of for c in t) else t.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        if any(re.search("[^▁]▁", p) for p in pieces):
            raise ValueError("the piece vocabulary has pieces across words")
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.size_a, self.size_b = (np.array([len(x) for x in known], dtype=np.int64) for known in (self.bytes_a, self.bytes_b))
        self.span, self.pair_space = len(pieces), len(pieces) * len(self.bytes_a)  # a pair of ids is id of A * span + id of B
        #: ids in decimal, by what follows them
        self.said = np.array([[str(i) + after for i in range(max(len(self.bytes_a), len(pieces)))] for after in (",", "|", ";", "")], dtype=object)
        self._clear()

    def _clear(self) -> None:
        self.known: dict[str, int] = {}
        self.n = self.used = 0
        #: by stretch: tokens of A and of B, groups, overlaps, whether the bytes are the text's, first pair
        self.facts = np.zeros((0, 6), dtype=np.int64)
        self.pairs = np.zeros(0, dtype=np.int64)
        self.texts: list[str] = []

    def _learn(self, stretches: list[str]) -> None:
        """Align new stretches (without the space before each), all at once: a cut ends each of them."""
        ids_a = [e.ids for e in self.a.encode_batch_fast([" " + s for s in stretches], add_special_tokens=False)]
        ids_b = self.b.encode(stretches, num_threads=1)
        of_a, of_b = self.bytes_a.__getitem__, self.bytes_b.__getitem__
        same = np.array([b"".join(map(of_a, a)) == (" " + s).encode() == b"".join(map(of_b, b)) for a, b, s in zip(ids_a, ids_b, stretches)], dtype=bool)
        of = np.flatnonzero(same)
        if len(of) < len(stretches):
            ids_a, ids_b = [ids_a[i] for i in of.tolist()], [ids_b[i] for i in of.tolist()]
        number_a, number_b = (np.fromiter(map(len, ids), dtype=np.int64, count=len(of)) for ids in (ids_a, ids_b))
        flat_a, flat_b = (np.fromiter(chain.from_iterable(ids), dtype=np.int64) for ids in (ids_a, ids_b))
        a, b, cut = align(self.size_a[flat_a], self.size_b[flat_b])
        stretch = np.repeat(np.arange(len(of)), number_a)[a]
        ends_a, ends_b = a[cut], b[cut]
        groups = np.bincount(stretch[cut], minlength=len(of))
        facts = np.zeros((len(stretches), 6), dtype=np.int64)
        facts[of] = np.stack([number_a, number_b, groups, np.bincount(stretch, minlength=len(of)), np.ones(len(of), dtype=np.int64), self.used + np.cumsum(groups) - groups], axis=1)
        pairs = flat_a[ends_a] * self.span + flat_b[ends_b]
        # groups as text: each group's tokens of A, then those of B, each with what follows it
        size_a, size_b = np.diff(ends_a, prepend=-1), np.diff(ends_b, prepend=-1)
        after_a, after_b = np.zeros(len(flat_a), dtype=np.int64), np.zeros(len(flat_b), dtype=np.int64)
        after_a[ends_a], after_b[ends_b] = 1, 2
        after_b[np.cumsum(number_b) - 1] = 3
        said = np.empty(len(flat_a) + len(flat_b), dtype=object)
        said[np.arange(len(flat_a)) + np.repeat(ends_b + 1 - size_b, size_a)] = self.said[after_a, flat_a]
        said[np.arange(len(flat_b)) + np.repeat(ends_a + 1, size_b)] = self.said[after_b, flat_b]
        said, to, texts = said.tolist(), np.cumsum(number_a + number_b).tolist(), [""] * len(stretches)
        for i, start, end in zip(of.tolist(), [0, *to], to):
            texts[i] = "".join(said[start:end])
        self.facts = np.concatenate([self.facts[: self.n], facts, np.zeros((max(0, self.n // 2), 6), dtype=np.int64)]) if self.n + len(facts) > len(self.facts) else self.facts
        self.facts[self.n : self.n + len(facts)] = facts
        if self.used + len(pairs) > len(self.pairs):
            self.pairs = np.concatenate([self.pairs[: self.used], np.zeros(self.used // 2 + len(pairs), dtype=np.int64)])
        self.pairs[self.used : self.used + len(pairs)] = pairs
        self.texts += texts
        self.n, self.used = self.n + len(facts), self.used + len(pairs)

    def numbers(self, stretches: list[str]) -> np.ndarray:
        """The number of each stretch; numbers hold until the next call."""
        if self.n > MAX_KEPT:
            self._clear()
        known, new = self.known, {}
        for s in stretches:
            if s not in known and s not in new:
                new[s] = len(new)
        if new:
            first = self.n
            self._learn(list(new))
            known.update((s, first + i) for s, i in new.items())
        found = np.fromiter(map(known.__getitem__, stretches), dtype=np.int64, count=len(stretches))
        for s in [s for s in new if len(s) > LONG]:
            del known[s]
        return found


_ALIGNERS: dict[tuple[str, str], Aligner] = {}


def aligner(paths: tuple[str, str]) -> Aligner:
    """The process's aligner: what it has learned serves the worker's next tasks too."""
    if paths not in _ALIGNERS:
        _ALIGNERS[paths] = Aligner(*paths)
    return _ALIGNERS[paths]


_DOCUMENT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_overlaps long, groups_sha256 string, pairs array<long>, times array<int>"
#: Characters of text aligned at once; a longer text goes through in parts of so many stretches.
_CHARACTERS, _PART = 1 << 20, 1 << 17


def _parts(texts: list[str | None]) -> Iterator[tuple[int, list[str]]]:
    """(text's number, its next stretches): texts in parts of bounded size."""
    for i, text in enumerate(texts):
        if not text:
            continue
        if len(text) <= _CHARACTERS:
            yield i, _STRETCH.split(text)
            continue
        part, at = [], 0
        for m in _STRETCH.finditer(text):
            part.append(text[at : m.start()])
            at = m.end()
            if len(part) >= _PART:
                yield i, part
                part = []
        yield i, [*part, text[at:]]


def _batch(known: Aligner, texts: list[str | None]) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray, np.ndarray]:
    """(five totals of each text, digests, offsets of its pairs, pairs, times)."""
    n = len(texts)
    totals, bad = np.zeros((n, 5), dtype=np.int64), np.zeros(n, dtype=bool)
    digests: list = [None] * n
    pair_space = known.pair_space
    keys, times = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]

    def flush(held: list[tuple[int, list[str]]]) -> None:
        number = known.numbers([s for _, part in held for s in part])
        size = np.array([len(part) for _, part in held], dtype=np.int64)
        text = np.repeat(np.array([i for i, _ in held], dtype=np.int64), size)
        facts = known.facts[number]
        np.add.at(totals, text, facts[:, :5])
        bad[text[facts[:, 4] == 0]] = True
        at, kept = 0, known.texts
        for (i, part), found in zip(held, np.split(number, np.cumsum(size)[:-1])):
            if not bad[i]:
                said = ";".join([kept[j] for j in found.tolist()]).encode()
                if digests[i] is None:
                    digests[i] = hashlib.sha256(said)
                else:
                    digests[i].update(b";" + said)
            at += len(part)
        pairs = known.pairs[N.ranges(facts[:, 5], facts[:, 2])]
        key, count = np.unique(np.repeat(text, facts[:, 2]) * pair_space + pairs, return_counts=True)
        keys.append(key)
        times.append(count)

    held, size = [], 0
    for i, part in _parts(texts):
        held.append((i, part))
        size += len(part)
        if size >= _PART:
            flush(held)
            held, size = [], 0
    if held:
        flush(held)
    key, where = np.unique(np.concatenate(keys), return_inverse=True)
    count = np.bincount(where, weights=np.concatenate(times), minlength=len(key)).astype(np.int64)
    good = ~bad[key // pair_space]
    key, count = key[good], count[good]
    totals[bad] = 0
    found = ["" if d is None or bad[i] else d.hexdigest() for i, d in enumerate(digests)]
    return totals, found, np.searchsorted(key // pair_space, np.arange(n + 1)), key % pair_space, count


def alignments(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizers: tuple[str, str] | None = None) -> DataFrame:
    """A row per row of ``docs``: numbers of tokens, groups, links and overlaps, digest of the groups, distinct linked pairs and how often each."""
    paths = tokenizers or default_tokenizers()
    settle(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = aligner(paths)
        for batch in batches:
            if not batch.num_rows:
                continue
            totals, digests, offsets, pairs, times = _batch(known, batch.column("text").to_pylist())
            at = pa.array(offsets.astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(totals[:, k]) for k in (0, 1, 2, 2, 3)), pa.array(digests, pa.string()), pa.ListArray.from_arrays(at, pa.array(pairs)), pa.ListArray.from_arrays(at, pa.array(times.astype(np.int32)))],
                ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_overlaps", "groups_sha256", "pairs", "times"],
            )

    return id_text(docs, id_col, text_col).mapInArrow(run, _DOCUMENT)


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(pair, n): how many links of the corpus each pair of ids has, summed in batches before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, sums, size = [], [], 0

        def merged() -> tuple[np.ndarray, np.ndarray]:
            key, where = np.unique(np.concatenate(keys), return_inverse=True)
            return key, np.bincount(where, weights=np.concatenate(sums), minlength=len(key)).astype(np.int64)

        for batch in batches:
            key, times = (batch.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("pairs", "times"))
            keys.append(key)
            sums.append(times.astype(np.int64))
            size += len(key)
            if size > 1 << 20:
                key, total = merged()
                keys, sums, size = [key], [total], 0
                if len(key) > 1 << 19:
                    yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(total)], ["pair", "n"])
                    keys, sums = [], []
        if keys:
            key, total = merged()
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(total)], ["pair", "n"])

    return aligned.select("pairs", "times").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))


_COLUMNS = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "n_overlaps")


def _looked_up(aligned: DataFrame, counts: DataFrame, span: int) -> DataFrame:
    """n_best and count_sum by a broadcast of the counts, ordered by pair."""
    rows = counts.toArrow()
    pair, n = (rows.column(c).to_numpy() for c in ("pair", "n"))
    order = np.argsort(pair)
    pair, n = pair[order], n[order]
    highest = np.zeros(span, dtype=np.int64)
    np.maximum.at(highest, pair % span, n)
    sent = aligned.sparkSession.sparkContext.broadcast((pair, n, n == highest[pair % span]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, n, best = sent.value
        for batch in batches:
            lists = batch.column("pairs")
            key, times = lists.flatten().to_numpy(zero_copy_only=False), batch.column("times").flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            at = np.searchsorted(pair, key)
            ends = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))]).astype(np.int64)
            sums = [np.concatenate([[0], np.cumsum(x)]) for x in (times * n[at], times * best[at])]
            total, first = (s[ends[1:]] - s[ends[:-1]] for s in sums)
            rest = {c: batch.column(c) for c in _COLUMNS if c not in ("n_best", "count_sum")} | {"n_best": pa.array(first), "count_sum": pa.array(total)}
            yield pa.RecordBatch.from_arrays([rest[c] for c in _COLUMNS], list(_COLUMNS))

    return aligned.mapInArrow(run, ", ".join(f"{c} {'string' if c == 'groups_sha256' else 'long'}" for c in _COLUMNS))


def _joined(aligned: DataFrame, counts: DataFrame, span: int) -> DataFrame:
    """n_best and count_sum by a join of every text's distinct pairs with the counts, for any number of pairs."""
    highest = counts.groupBy((F.col("pair") % span).alias("b")).agg(F.max("n").alias("highest"))
    known = table(counts.join(highest, F.col("pair") % span == F.col("b")).select("pair", "n", (F.col("n") == F.col("highest")).cast("long").alias("best")), "pairs")
    linked = aligned.select("uid", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("uid", F.col("x.pairs").alias("pair"), F.col("x.times").alias("times"))
    sums = linked.join(known, "pair").groupBy("uid").agg(F.sum(F.col("times") * F.col("best")).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum"))
    return aligned.drop("pairs", "times").join(sums, "uid", "left").select(*(F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c) if c in ("n_best", "count_sum") else c for c in _COLUMNS))


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizers: tuple[str, str] | None = None, most_pairs: int = MOST_PAIRS) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 and n_overlaps of every row.

    Links are the pairs of tokens that end at the same byte; ``n_overlaps`` counts the
    pairs that share a byte.  A null or empty text, and one that a tokenizer doesn't give
    back byte by byte, has no tokens: zeros and ''.  Repeated rows each have a row and count
    each in the corpus, and null ids stay; an empty table gives no rows; other columns are
    ignored.  A very long text goes through in parts of 131,072 stretches.  Counts of up to ``most_pairs``
    pairs are broadcast (the vocabularies bound them, not the corpus); more are joined, with the same result.
    """
    paths = tokenizers or default_tokenizers()
    aligned = table(alignments(docs, id_col, text_col, paths).withColumn("uid", F.monotonically_increasing_id()), "aligned", compression="zstd")
    counts = table(pair_counts(aligned), "counts")
    span = Aligner(*paths).span
    if counts.count() <= most_pairs:
        out = _looked_up(aligned, counts, span)
        drop(counts)
        return out
    return _joined(aligned, counts, span)
