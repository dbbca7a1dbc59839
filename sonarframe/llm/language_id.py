"""Language by bit-sliced Bloom filters over byte n-grams.

One filter holds a mask of languages in each place; the masks at the ``HASHES``
places of an n-gram, and-ed, say at once which languages contain it.  For each
language the n-grams of a text whose mask has its bit are counted (a popcount
over the text) and the count is corrected for the filter's false positives.

Every n-gram of every language is in the filters, and each language that contains
it has its bit.  A second filter tells where a language's rate is close to the
leading one's: such a hit counts 1, another ``CONTAINS``.  Shards of bounded size,
by a hash of the n-gram, together cover all.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sonarframe.llm import textnum as N
from sonarframe.llm.kneser_ney import BLOCK_BYTES, SLICE_BYTES, _grams, blocks, codes, distinct, once
from sonarframe.llm.shared import drop, held_out, id_text, named, settle, table

ORDER, HASHES = 5, 3
#: n-grams in a shard, about, for up to 8 languages (fewer for more): there are as many shards as the n-grams need.
SHARD_GRAMS = 1 << 20
#: The weight of a hit where a language uses the n-gram at less than this, measured by the language that uses it most.
CONTAINS = 0.1
_SPREAD = 2654435
UNDETERMINED = "und"


def count(labelled: DataFrame, order: int = ORDER) -> DataFrame:
    """(lang, gram, n) over all of ``labelled`` (text, lang)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}
        size = 0

        def merged():
            for lang, parts in held.items():
                keys, where = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
                n = np.bincount(where, np.concatenate([p[1] for p in parts]), len(keys)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), pa.array(keys.view(np.int64)), pa.array(n)], ["lang", "gram", "n"])

        for batch in batches:
            langs = np.array(batch.column("lang").to_pylist(), dtype=object)
            for part in N.slices(batch.column("text")):
                keys = _grams(codes(part.data), part.offsets, order)
                mine, who = np.unique(langs[part.row : part.row + len(part)].astype(str), return_inverse=True)
                of = np.repeat(who, np.diff(part.offsets))
                for i, lang in enumerate(mine):
                    u, n = np.unique(keys[of == i], return_counts=True)
                    held.setdefault(lang, []).append((u, n))
                    size += len(u)
            if size > 500_000:
                yield from merged()
                held, size = {}, 0
        yield from merged()

    return labelled.select("text", "lang").mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


class Filters:
    """Masks of languages that contain an n-gram, and of those that lead in it; ``false`` is each language's rate of false positives."""

    def __init__(self, langs: list[str], prior: np.ndarray, grams: np.ndarray, contains: np.ndarray, leads: np.ndarray | None = None, hashes: int = HASHES, weight: float = CONTAINS):
        self.langs, self.prior, self.hashes, self.weight = langs, prior, hashes, weight
        self.size = max(1024, 8 << int(max(1, len(grams)) - 1).bit_length())
        self.masks, self.false = self._fill(grams, contains)
        self.leading, self.false_leading = self._fill(grams, contains if leads is None else leads)

    def _fill(self, grams: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = len(self.langs)
        kind = next((k for w, k in ((8, np.uint8), (16, np.uint16), (32, np.uint32)) if n <= w), np.uint64)
        masks = np.zeros((-(-n // 64), self.size), dtype=kind)
        for place in self._places(grams):
            for lang in range(n):
                masks[lang // 64, place[bits[:, lang]]] |= kind(1 << (lang % 64))
        return masks, np.array([float(np.mean((masks[i // 64] >> kind(i % 64)) & kind(1))) ** self.hashes for i in range(n)])

    def _places(self, grams: np.ndarray) -> Iterator[np.ndarray]:
        h = N.mix(grams)
        step = N.mix(grams ^ np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
        for _ in range(self.hashes):
            yield (h & np.uint64(self.size - 1)).astype(np.int64)
            h = h + step

    def languages_of(self, grams: np.ndarray, masks: np.ndarray | None = None) -> np.ndarray:
        """For each word of 64 languages, the mask of languages that contain each n-gram."""
        masks = self.masks if masks is None else masks
        out = np.full((len(masks), len(grams)), np.iinfo(masks.dtype).max, dtype=masks.dtype)
        for place in self._places(grams):
            out &= masks[:, place]
        return out

    def values(self, grams: np.ndarray) -> np.ndarray:
        """For each language, what each n-gram adds to its share: the weight of a hit, corrected for false positives."""
        some, close = self.languages_of(grams), self.languages_of(grams, self.leading)
        out = np.empty((len(self.langs), len(grams)), dtype=np.float32)
        one = some.dtype.type(1)
        for i in range(len(self.langs)):
            word, bit = i // 64, some.dtype.type(i % 64)
            code = ((some[word] >> bit) & one) + (((close[word] >> bit) & one) << one)
            hit = [np.array([-f, 1 - f]) / max(1 - f, 1e-9) for f in (self.false[i], self.false_leading[i])]
            each = [self.weight * hit[0][c & 1] + (1 - self.weight) * hit[1][c >> 1] for c in range(4)]
            out[i] = np.array(each, dtype=np.float32)[code]
        return out


class Languages:
    """What is known of all languages: shards of filters (broadcast where a cluster predicts)."""

    def __init__(self, langs: list[str], prior: np.ndarray, shards: list, order: int = ORDER):
        self.langs, self.prior, self.shards, self.order = langs, prior, shards, order

    def _values(self, parts: Iterator[N.Slice]) -> Iterator[tuple[N.Slice, np.ndarray]]:
        if len(self.shards) == 1:
            shard = self.shards[0].value if isinstance(self.shards[0], Broadcast) else self.shards[0]
            for part in parts:
                yield part, shard.values(_grams(codes(part.data), part.offsets, self.order))
            return
        for block in blocks(parts, 4 * BLOCK_BYTES // max(4, len(self.langs))):
            keys, places = distinct(_grams(codes(part.data), part.offsets, self.order) for part in block)
            of, out = (_product(keys) % np.uint64(len(self.shards))).astype(np.int64), np.zeros((len(self.langs), len(keys)), dtype=np.float32)
            for i, shard in enumerate(self.shards):
                mine = np.flatnonzero(of == i)
                if len(mine):
                    out[:, mine] = once(shard).values(keys[mine])
            for part, place in zip(block, places):
                yield part, out[:, place]

    def shares(self, column) -> np.ndarray:
        """Corrected and weighted share of each text's n-grams that each language contains."""
        out = [np.zeros((0, len(self.langs)))]
        for part, values in self._values(N.slices(column, limit=SLICE_BYTES)):
            n = np.diff(part.offsets)
            share = np.zeros((len(part), len(self.langs)))
            for i, v in enumerate(values):
                sums = np.concatenate([[0], np.cumsum(v, dtype=np.float64)])
                share[:, i] = (sums[part.offsets[1:]] - sums[part.offsets[:-1]]) / np.maximum(n, 1)
            out.append(np.clip(share.round(8), 0, 1))  # sums differ in the last digits where shares are equal
        return np.concatenate(out)


def _product(grams: np.ndarray) -> np.ndarray:
    return (grams * np.uint64(_SPREAD)) >> np.uint64(24)


def _shard(gram: Column, shards: int) -> Column:
    """As ``_product`` modulo ``shards``; 40 bits of an n-gram and 22 of the factor don't overflow."""
    return F.shiftright(gram * F.lit(_SPREAD), 24) % F.lit(shards)


def fit(labelled: DataFrame, order: int = ORDER, shard_grams: int = SHARD_GRAMS, contains: float = CONTAINS) -> Languages | None:
    """Filters of the languages of ``labelled`` (text, lang), or None if it has none."""
    langs = sorted((r.lang, r.n) for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect())
    if not langs:
        return None
    counts = table(count(labelled, order), "grams")
    totals = {r.lang: r.n for r in counts.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    grams = counts.agg(F.approx_count_distinct("gram", 0.02)).first()[0]
    shards = max(1, -(-grams * max(8, len(langs)) // (8 * shard_grams)))
    names, n = [lang for lang, _ in langs], np.array([c for _, c in langs], dtype=float)

    def filters(i: int) -> Filters:
        mine = counts.where(_shard(F.col("gram"), shards) == i) if shards > 1 else counts
        rows = mine.select("gram", "lang", "n").toArrow()
        keys, at = np.unique(rows.column("gram").to_numpy().view(np.uint64), return_inverse=True)
        lang = rows.column("lang").combine_chunks().dictionary_encode() if rows.num_rows else pa.array([], pa.string()).dictionary_encode()
        place = {name: k for k, name in enumerate(names)}
        of = np.array([place[name] for name in lang.dictionary.to_pylist()], dtype=np.int64)[lang.indices.to_numpy()] if rows.num_rows else at
        share = np.zeros((len(keys), len(names)))
        share[at, of] = rows.column("n").to_numpy() / np.array([max(1, totals.get(name, 0)) for name in names])[of]
        leads = (share > 0) & (share >= contains * share.max(axis=1, keepdims=True))
        return Filters(names, n / n.sum(), keys, share > 0, leads, weight=contains)

    context = labelled.sparkSession.sparkContext
    out = [context.broadcast(filters(i)) for i in range(shards)]
    drop(counts)
    return Languages(names, n / n.sum(), out, order)


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def predict(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """doc_id, held_out, lang_pred, score for each row of ``docs``.

    Learns from rows with a text and a language that aren't held out.  A null text or
    one without a letter is ``und`` with score 0, and so is every text if there is
    nothing to learn from.  The score is the winner's corrected and weighted share; equal shares go
    to the language with more learned rows, then to the first by name.  An empty lang is a language of that name.  A very long text counts
    whole, in slices; a row with a null id is held out and predicted; repeated rows each have a row; an empty table gives none.
    """
    settle(docs.sparkSession)
    rows = id_text(docs, id_col, text_col)
    known = docs.select(named(id_col).cast("long").alias("doc_id"), named(text_col).cast("string").alias("text"), named(lang_col).cast("string").alias("lang"))
    known = known.where(~held_out(F.col("doc_id")) & F.col("text").isNotNull() & F.col("lang").isNotNull())
    filters = fit(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known = filters
            letters = np.array([has_letter(t.as_py()) for t in batch.column("text")], dtype=bool)
            if known is None:
                names, score = [UNDETERMINED] * batch.num_rows, np.zeros(batch.num_rows)
            else:
                share = known.shares(batch.column("text"))
                best = (share + 1e-9 * known.prior).argmax(axis=1) if len(share) else np.zeros(0, dtype=int)
                names = [known.langs[b] if ok else UNDETERMINED for b, ok in zip(best, letters)]
                score = np.where(letters, share[np.arange(len(share)), best], 0.0)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(names, pa.string()), pa.array(score)], ["doc_id", "held_out", "lang_pred", "score"])

    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text").mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")
