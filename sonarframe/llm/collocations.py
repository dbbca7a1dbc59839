"""Phrase collocations, counted by suffix-sigma.

Each place in a text begins a suffix of at most ``MAX_WORDS`` words, cut at the end
of its piece.  Suffixes are shuffled by language and first word, in ranges, so that
the rows of a frequent first word are divided at the words after it; they're sorted
reverse-lexicographically, and one stack counts all their prefixes in a single pass:
a prefix is complete when a suffix comes that doesn't begin with it.  What is still open at the edges of a
range is added up afterwards.  Parts of phrases are looked up by joins.

A phrase can't be more frequent than its words and its pairs of words, so suffixes end
before the first word, and between the first two, that a bitmap of frequent ones
excludes; the bitmaps let too much through, never too little.  Within a batch equal
suffixes become one row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sonarframe.llm import keyfilter
from sonarframe.llm import textnum as N
from sonarframe.llm.shared import drop, named, settle, table

MAX_WORDS, LEAST, TOP = 5, 100, 2000
#: A longer phrase as frequent as so many hundredths of a shorter one's count stands for it.
COVERS = 100
#: Rows taken together by the stack, bytes of text at once, and lists of a language for the first selection.
_ROWS, _BYTES, _LISTS = 1 << 16, 1 << 22, 32
#: Distinct pairs of words that a task adds up before it gives them to the shuffle.
_PAIRS = 1 << 20
#: Between the words of a suffix: sorts before all else, so that a prefix's rows are together.  Bytes 0 and 1 of texts are written as two bytes.
_BETWEEN = "\x00"

_IS_BREAK, _IS_GAP = np.zeros(256, dtype=bool), np.zeros(256, dtype=bool)
_IS_BREAK[list(b".,;:!?\n\x0b\x0c\r")] = True
_IS_GAP[list(b" \t")] = True


def _escaped(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes 0 and 1 as 1 1 and 1 2, which keeps their order."""
    low = data < 2
    if not low.any():
        return data, offsets
    size = 1 + low
    out = np.repeat(data, size)
    at = (np.cumsum(size) - 1)[low]
    out[at], out[at - 1] = data[low] + 1, 1
    return out, np.concatenate([[0], np.cumsum(size)])[offsets]


class Words:
    """Words of consecutive texts: ``starts`` and ``ends`` in ``data``, the text each is of, and whether a word goes on its predecessor's piece."""

    def __init__(self, part: N.Slice):
        data, offsets = _escaped(part.data, part.offsets)
        self.data, n = data, len(data)
        edge = _IS_BREAK[data]
        inside = ~(edge | _IS_GAP[data])
        first, last = inside.copy(), inside.copy()
        if n:
            inner = offsets[(offsets > 0) & (offsets < n)]
            first[1:] &= ~inside[:-1]
            first[inner] = inside[inner]
            last[:-1] &= ~inside[1:]
            last[inner - 1] = inside[inner - 1]
        self.starts, self.ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.text = np.repeat(np.arange(len(offsets) - 1), np.diff(np.searchsorted(self.starts, offsets)))
        breaks = np.concatenate([[0], np.cumsum(edge)])
        self.goes_on = np.zeros(len(self.starts), dtype=bool)
        self.goes_on[1:] = (breaks[self.starts[1:]] == breaks[self.ends[:-1]]) & (self.text[1:] == self.text[:-1])

    def hashes(self) -> np.ndarray:
        return N.hash_spans(self.data, self.starts, self.ends)


def _languages(column: pa.Array) -> tuple[np.ndarray, list[str], np.ndarray]:
    """(code of each row, languages, a hash of each)."""
    coded = column.dictionary_encode()
    names = coded.dictionary.to_pylist()
    data = np.frombuffer("".join(names).encode(), dtype=np.uint8)
    ends = np.cumsum([len(x.encode()) for x in names]).astype(np.int64)
    return coded.indices.to_numpy(zero_copy_only=False), names, N.hash_spans(data, np.concatenate([[0], ends[:-1]]).astype(np.int64), ends, 1) if names else np.zeros(0, dtype=np.uint64)


def _keys(words: Words, hashes: np.ndarray, of_language: np.ndarray, code: np.ndarray) -> np.ndarray:
    """A hash of language and word."""
    return N.mix(hashes ^ of_language[code[words.text]])


def _prepared(docs: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    return docs.select(F.coalesce(named(lang_col).cast("string"), F.lit("und")).alias("lang"), named(text_col).cast("string").alias("text"))


def word_counts(texts: DataFrame) -> DataFrame:
    """(key, lang, n): occurrences of each hash of language and word, and (null, lang, n) all words of a language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            code, names, of_language = _languages(batch.column("lang"))
            totals = np.zeros(len(names), dtype=np.int64)
            for part in N.slices(batch.column("text"), fold_case=True, limit=_BYTES):
                words = Words(part)
                here = code[part.row : part.row + len(part)]
                key, n = np.unique(_keys(words, words.hashes(), of_language, here), return_counts=True)
                totals += np.bincount(here[words.text], minlength=len(names))
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.nulls(len(key), pa.string()), pa.array(n)], ["key", "lang", "n"])
            yield pa.RecordBatch.from_arrays([pa.nulls(len(names), pa.int64()), pa.array(names, pa.string()), pa.array(totals)], ["key", "lang", "n"])

    return texts.mapInArrow(run, "key long, lang string, n long").groupBy("key", "lang").agg(F.sum("n").alias("n"))


def _pairs(words: Words, keys: np.ndarray, frequent: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places of frequent words that go on another frequent one's piece, a hash of language and both words)."""
    at = np.flatnonzero(words.goes_on[1:] & frequent[1:] & frequent[:-1]) + 1
    return at, N.mix(keys[at - 1] * np.uint64(3) ^ N.mix(keys[at]))


def _summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    every, of = np.unique(np.concatenate(keys), return_inverse=True)
    return every, np.bincount(of, np.concatenate(counts), len(every)).astype(np.int64)


def pair_counts(texts: DataFrame, frequent) -> DataFrame:
    """(key, n): occurrences of each hash of language and two words in a row, both in the bitmap ``frequent``; added up in tasks before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, keys, counts = keyfilter.Filter(frequent.value), [], []
        row = lambda: pa.RecordBatch.from_arrays([pa.array(keys[0].view(np.int64)), pa.array(counts[0])], ["key", "n"])
        for batch in batches:
            if not batch.num_rows:
                continue
            code, _, of_language = _languages(batch.column("lang"))
            for part in N.slices(batch.column("text"), fold_case=True, limit=_BYTES):
                words = Words(part)
                own = _keys(words, words.hashes(), of_language, code[part.row : part.row + len(part)])
                key, n = np.unique(_pairs(words, own, known.maybe([own.view(np.int64)]))[1], return_counts=True)
                keys, counts = ([x] for x in _summed([*keys, key], [*counts, n]))
                if len(keys[0]) > _PAIRS:
                    yield row()
                    keys, counts = [], []
        if keys:
            yield row()

    return texts.mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


def _lengths(joins: np.ndarray, frequent: np.ndarray, most: int) -> np.ndarray:
    """Words of the suffix at each place: up to ``most``, none if its first isn't frequent, as far as each word ``joins`` the one before."""
    n = len(frequent)
    alive, out = frequent.copy(), frequent.astype(np.int64)
    for k in range(1, min(most, n)):
        alive[: n - k] &= joins[k:]
        alive[n - k :] = False
        out += alive
    return out


def _distinct(words: Words, hashes: np.ndarray, code: np.ndarray, size: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(places of distinct suffixes, how often each occurs); words are compared byte by byte, not only by hash."""
    word, same, number = np.unique(hashes, return_index=True, return_inverse=True)
    length = words.ends - words.starts
    model, short = same[number], length <= N.LONG_WORD
    alike = (length == length[model]) & short
    at8 = N.eights(words.data)
    check = np.flatnonzero(alike)
    alike[check] = N.same_bytes(at8, words.starts[check], at8, words.starts[model[check]], length[check])
    odd = np.flatnonzero(~alike)  # very long words, and those whose hash is another's: by their bytes
    if len(odd):
        named_by: dict[bytes, int] = {}
        for i in odd.tolist():
            number[i] = len(word) + named_by.setdefault(words.data[words.starts[i] : words.ends[i]].tobytes(), len(named_by))
    at = np.flatnonzero(size)
    language = code[words.text[at]].astype(np.int64)
    padded = np.concatenate([number, np.zeros(most, dtype=np.int64)])
    columns = [np.where(size[at] > k, padded[at + k] + 1, 0) for k in range(most)]
    key = language.astype(np.uint64)
    for c in columns:
        key = N.mix(key * np.uint64(3) ^ c.astype(np.uint64))
    _, first, of, n = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
    differs = language != language[first[of]]
    for c in columns:
        differs |= c != c[first[of]]
    alone = np.flatnonzero(differs)  # another suffix's hash: rows of their own
    n -= np.bincount(of[alone], minlength=len(n))
    return at[np.concatenate([first, alone])], np.concatenate([n, np.ones(len(alone), dtype=np.int64)])


def _strings(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    return pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data[N.ranges(starts, sizes)]))).cast(pa.string())


def suffixes(texts: DataFrame, frequent, pairs, most: int = MAX_WORDS) -> DataFrame:
    """(lang, suffix, n): the suffixes of all texts, their words joined by ``_BETWEEN``, equal ones of a batch in one row.

    ``frequent`` and ``pairs`` are broadcast bitmaps of the words and pairs of words that may be part of a phrase.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, known_pairs = keyfilter.Filter(frequent.value), keyfilter.Filter(pairs.value)
        for batch in batches:
            if not batch.num_rows:
                continue
            code, names, of_language = _languages(batch.column("lang"))
            for part in N.slices(batch.column("text"), fold_case=True, limit=_BYTES):
                words = Words(part)
                hashes, here = words.hashes(), code[part.row : part.row + len(part)]
                own = _keys(words, hashes, of_language, here)
                alive, joins = known.maybe([own.view(np.int64)]), np.zeros(len(own), dtype=bool)
                place, pair = _pairs(words, own, alive)
                joins[place] = known_pairs.maybe([pair.view(np.int64)])
                size = _lengths(joins, alive, most)
                at, n = _distinct(words, hashes, here, size, most)
                # all words, each followed by one separator
                length = words.ends - words.starts
                flat = np.concatenate([words.data, np.zeros(1, dtype=np.uint8)])[N.ranges(words.starts, length + 1)]
                end = np.cumsum(length + 1) - 1
                flat[end] = 0
                start = end - length
                yield pa.RecordBatch.from_arrays(
                    [pa.DictionaryArray.from_arrays(pa.array(here[words.text[at]].astype(np.int32)), pa.array(names, pa.string())).cast(pa.string()), _strings(flat, start[at], end[at + size[at] - 1] - start[at]), pa.array(n)], ["lang", "suffix", "n"]
                )

    return texts.mapInArrow(run, "lang string, suffix string, n long")


class Stack:
    """Counts prefixes of suffixes that come in reverse order; chunks of rows at a time.

    Between chunks it keeps the last suffix, the count of each of its prefixes so far,
    and which of them are open since the range's first row.
    """

    def __init__(self, most: int, least: int):
        self.most, self.least, self.last = most, least, None
        self.count, self.edge = np.zeros(most, dtype=np.int64), np.ones(most, dtype=bool)

    def push(self, langs: pa.Array, suffix: pa.Array, n: np.ndarray, end: bool = False) -> pa.RecordBatch:
        """(lang, phrase, words, n) of prefixes that are complete and frequent, or touch an edge of the range."""
        if self.last is not None:
            langs, suffix, n = pa.concat_arrays([self.last[0], langs]), pa.concat_arrays([self.last[1], suffix]), np.concatenate([[0], n])
        rows = len(n)
        data, offsets = N.raw(suffix)
        data, offsets = data[offsets[0] : offsets[-1]], offsets - offsets[0]
        coded = langs.dictionary_encode()
        language = coded.indices.to_numpy(zero_copy_only=False)
        gaps = np.flatnonzero(data == 0)
        row = np.searchsorted(offsets, gaps, side="right") - 1
        words = 1 + np.bincount(row, minlength=rows)
        ends = np.repeat(offsets[1:, None], self.most, axis=1)  # of word k of each row
        ends[row, N.ranges(np.zeros(rows, dtype=np.int64), words - 1)] = gaps
        at8, start, out = N.eights(data), offsets[:-1], []
        same = np.concatenate([[False], language[1:] == language[:-1]])  # so far, as the row before
        count, edge = np.zeros(self.most, dtype=np.int64), np.zeros(self.most, dtype=bool)
        for k in range(self.most):
            size = ends[:, k] - start
            check = np.flatnonzero(same & (words > k))
            check = check[(words[check - 1] > k) & (size[check] == size[check - 1])]
            same = np.zeros(rows, dtype=bool)
            same[check] = N.same_bytes(at8, start[check], at8, start[check - 1], size[check])
            has = np.flatnonzero(words > k)
            start = np.minimum(ends[:, k] + 1, offsets[1:])
            if not len(has):
                continue
            own = n[has]
            own[0] += self.count[k] if has[0] == 0 else 0
            first = np.flatnonzero(~same[has])
            total, head = np.add.reduceat(own, first), has[first]
            keep, at_edge, is_open = total >= self.least, head[0] == 0 and self.edge[k], has[-1] == rows - 1
            keep[0] |= at_edge
            if is_open:
                keep[-1] = end
                count[k], edge[k] = total[-1], at_edge and len(head) == 1
            head, total = head[keep], total[keep]
            out.append((coded.dictionary.take(pa.array(language[head])), _strings(data, offsets[head], ends[head, k] - offsets[head]), pa.array(np.full(len(head), k + 1, dtype=np.int32)), pa.array(total)))
        self.count, self.edge, self.last = count, edge, (langs[-1:], suffix[-1:])
        return pa.RecordBatch.from_arrays([pa.concat_arrays(c) for c in zip(*out)], ["lang", "phrase", "words", "n"])


def phrase_counts(rows: DataFrame, most: int = MAX_WORDS, least: int = LEAST) -> DataFrame:
    """(lang, phrase, words, f) of all phrases of ``suffixes`` that occur ``least`` times or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stack, held, size = Stack(most, least), [], 0

        def taken(end: bool) -> pa.RecordBatch:
            whole = pa.Table.from_batches(held).combine_chunks()
            lang, suffix, n = (c.chunk(0) if c.num_chunks else pa.array([], c.type) for c in whole.columns)
            return stack.push(lang, suffix, n.to_numpy(zero_copy_only=False).astype(np.int64), end)

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                size += batch.num_rows
                if size >= _ROWS:
                    yield taken(False)
                    held, size = [batch.slice(0, 0)], 0
        if held:
            yield taken(True)

    dealt = rows.repartitionByRange("lang", F.col("suffix").desc()).sortWithinPartitions("lang", F.col("suffix").desc())
    found = dealt.mapInArrow(run, "lang string, phrase string, words int, n long")
    return found.groupBy("lang", "phrase", "words").agg(F.sum("n").alias("f")).where(F.col("f") >= least)


def score(a, n, left, right):
    """floor(1000 * a * n / (left * right)), exactly."""
    big = lambda c: c.cast("decimal(19,0)")
    over = F.lit(1000).cast("decimal(4,0)") * big(a) * big(n)
    return F.call_function("div", over, big(left) * big(right))


def scored(counts: DataFrame, totals: DataFrame, most: int = MAX_WORDS, covers: int = COVERS) -> DataFrame:
    """lang, phrase (words still joined by ``_BETWEEN``), a, l, r, n, score of each phrase that no longer one covers.

    ``counts``: (lang, phrase, words, f) with every part of a phrase; ``totals``: (lang, n).
    """
    word = F.split("phrase", _BETWEEN)
    piece = lambda start, size: F.array_join(F.slice("w", start, size), _BETWEEN)
    cuts = F.flatten(F.transform(F.sequence(F.lit(1), F.col("words") - 1), lambda k: F.array(
        F.struct(k.alias("k"), F.lit(True).alias("left"), piece(F.lit(1), k).alias("part")),
        F.struct(k.alias("k"), F.lit(False).alias("left"), piece(k + 1, F.col("words") - k).alias("part")))))
    asked = counts.where("words > 1").withColumn("w", word).select("lang", "phrase", "words", F.col("f").alias("a"), F.inline(cuts))
    parts = table(asked.join(counts.select("lang", F.col("phrase").alias("part"), F.col("f").alias("f"), F.col("words").alias("size")), ["lang", "part"]), "parts")
    covered = parts.where((F.col("size") == F.col("words") - 1) & (F.col("size") > 1) & (100 * F.col("a") >= covers * F.col("f"))).select("lang", F.col("part").alias("phrase")).distinct()
    of = lambda k, left: F.max(F.when((F.col("k") == k) & (F.col("left") == left), F.col("f")))
    each = parts.groupBy("lang", "phrase", "a").agg(*(of(k, left).alias(f"{'l' if left else 'r'}{k}") for k in range(1, most) for left in (True, False)))
    each = each.join(totals, "lang").join(covered, ["lang", "phrase"], "left_anti")
    lowest = F.least(*(F.when(F.col(f"l{k}").isNotNull(), F.struct(score(F.col("a"), F.col("n"), F.col(f"l{k}"), F.col(f"r{k}")).alias("score"), F.lit(k).alias("k"), F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r"))) for k in range(1, most)), F.lit(None))
    return each.withColumn("cut", lowest).select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")


def mine(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", most: int = MAX_WORDS, least: int = LEAST, covers: int = COVERS, top: int | None = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's first ``top`` collocations (all, if None).

    A null language counts as ``und``, a null text as empty.  Repeated rows count each.
    An empty table, or one in which no phrase is frequent, gives no rows; other columns
    are ignored.  A very long text is a slice of its own.  Ties are settled by a, then by the phrase's bytes.
    """
    spark = docs.sparkSession
    settle(spark)
    texts = _prepared(docs, text_col, lang_col)
    numbers = word_counts(texts)
    numbers = table(numbers.where((F.col("n") >= least) | F.col("key").isNull()), "words")
    frequent = spark.sparkContext.broadcast(keyfilter.build(numbers.where("key IS NOT NULL").select("key")))
    often = table(pair_counts(texts, frequent).where(F.col("n") >= least).select("key"), "pairs")
    pairs = spark.sparkContext.broadcast(keyfilter.build(often))
    drop(often)
    rows = table(suffixes(texts, frequent, pairs, most), "suffixes", compression="zstd")
    counts = table(phrase_counts(rows, most, least), "phrases")
    drop(rows)
    found = table(scored(counts, numbers.where("key IS NULL").select("lang", "n"), most, covers), "scored")
    drop(numbers)
    found = found.withColumn("phrase", F.replace(F.replace(F.replace("phrase", F.lit(_BETWEEN), F.lit(" ")), F.lit("\x01\x01"), F.lit("\x00")), F.lit("\x01\x02"), F.lit("\x01")))
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    if top is not None:  # first each of a language's lists, so that a language's rows aren't sorted in one task
        found = found.withColumn("list", F.pmod(F.xxhash64("phrase"), F.lit(_LISTS)))
        found = found.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "list").orderBy(*order))).where(F.col("rank") <= top)
    found = found.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long"))
    return (found if top is None else found.where(F.col("rank") <= top)).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


#: The same by counting all phrases of whole pieces.
ORACLE = r"""
WITH pieces AS (
    SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
), worded AS (
    SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM pieces
), totals AS (
    SELECT lang, sum(len(w))::BIGINT AS n FROM worded GROUP BY lang
), places AS (
    SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM worded
), phrases AS (
    SELECT lang, w[i : i + m - 1] AS p, m, count(*) AS f FROM places, range(1, 6) AS sizes(m) WHERE i + m - 1 <= len(w) GROUP BY lang, p, m HAVING count(*) >= 100
), cuts AS (
    SELECT c.lang, c.p, c.f AS a, k, l.f AS l, r.f AS r, t.n, ((1000::HUGEINT * c.f * t.n) // (l.f::HUGEINT * r.f))::BIGINT AS score
    FROM phrases c, range(1, 5) AS ks(k), phrases l, phrases r, totals t
    WHERE c.m > 1 AND k < c.m AND l.lang = c.lang AND l.p = c.p[1 : k] AND r.lang = c.lang AND r.p = c.p[k + 1 : c.m] AND t.lang = c.lang
), lowest AS (
    SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, k) = 1
), covered AS (
    SELECT DISTINCT s.lang, s.p FROM phrases s, phrases b, range(0, 5) AS places(i)
    WHERE b.m > s.m AND i + s.m <= b.m AND s.m > 1 AND b.lang = s.lang AND b.p[i + 1 : i + s.m] = s.p AND 100 * b.f >= 100 * s.f
)
SELECT lang, rank, phrase, a, l, r, n, score FROM (
    SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(p, ' ')) AS rank, array_to_string(p, ' ') AS phrase, a, l, r, n, score
    FROM lowest ANTI JOIN covered USING (lang, p)
) WHERE rank <= 2000
"""
