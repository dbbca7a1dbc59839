"""Repeated spans of words across documents, by compaction of a de Bruijn graph.

Tokens are words.  The k-mers that are least among ``GAP`` consecutive ones
(minimizers) are the nodes; an edge is the run of words from one node of a document
through the next one, so two nodes and their distance tell all its words.  Wherever
a window of ``window`` words occurs, the nodes picked inside it are the same, and
there is an edge between them.

1. Edges that start in one document only can't be in a repeated window.  A bitmap of
   the others lets the rest of the work skip nearly all edges that occur once.
2. An edge is followed by one edge and that one preceded by it only, in all their
   occurrences: the node between is nonbranching.  Self-joins on such links, each
   doubling how far back an edge points (pointer jumping), compact the graph into
   its paths.  All of a path's edges occur in the same places, so one row for each
   occurrence of a path takes the place of one for each edge.
3. Windows inside a path are repeats of the path's first document; digests of the
   words at the coordinates of each occurrence are compared with those at the
   source's, and paths that hash together without having the same words fall apart.
4. Windows that cross the ends of paths, all of whose edges are repeated, are looked
   up one by one by a digest of their words.

Rows are proportional to the words: one for about 9 words in the first step, and
only repeated text after it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sonarframe.llm import keyfilter
from sonarframe.llm import textnum as N
from sonarframe.llm.shared import drop, free, id_text, row_key, settle, table

WINDOW, GAP, KMER = 50, 17, 17  # 2 * GAP + KMER <= WINDOW + 1, so that a window has two nodes; GAP <= KMER, so that they cover their edge
#: Edges of a document in one row.
PIECE = 1 << 15
_POSITION_BITS = 16

EDGES = "doc_id long, row long, edges array<long>, at array<int>, gaps array<int>, before long, after long"
WINDOWS = "doc_id long, row long, at int, path long, digest binary"


def sizes(window: int) -> tuple[int, int]:
    """Gap and k for a window: KMER and GAP, or less where the window is shorter."""
    gap = min(GAP, (window + 1) // 3)
    return gap, window + 1 - 2 * gap if gap < GAP else KMER


class Nodes:
    """The nodes of the documents of a slice that have a window: ``at`` (first word in the slice), ``doc``, and edges between neighbours."""

    def __init__(self, part: N.Slice, window: int, weaken: int = 0):
        gap, k = sizes(window)
        lengths = np.diff(part.word_offsets)
        hashes = part.word_hashes()
        kmers = N.runs(hashes, k)
        m = len(kmers) - gap + 1
        windows = np.where(lengths >= window, lengths - k - gap + 2, 0)  # runs of ``gap`` k-mers inside a document
        self.runs = N.ranges(part.word_offsets[:-1], windows)
        self.doc_of_run = np.repeat(np.arange(len(part)), windows)
        self.picked = np.zeros(0, dtype=np.int64)
        if len(self.runs):
            low = np.uint64((1 << _POSITION_BITS) - 1)
            chosen = np.empty(m, dtype=np.int64)
            for a in range(0, m, 1 << (_POSITION_BITS - 1)):  # positions count from the block's start, so they fit in any text
                block = kmers[a : a + (1 << (_POSITION_BITS - 1)) + gap - 1]
                least = N.sliding_min((block & ~low) | np.arange(len(block), dtype=np.uint64), gap)
                chosen[a : a + len(least)] = a + (least & low).astype(np.int64)
            self.picked = chosen[self.runs]
        new = np.ones(len(self.runs), dtype=bool)
        new[1:] = (self.picked[1:] != self.picked[:-1]) | (self.doc_of_run[1:] != self.doc_of_run[:-1])
        self.node_of_run = np.cumsum(new) - 1
        self.at, self.doc = self.picked[new], self.doc_of_run[new]
        inside = self.doc[1:] == self.doc[:-1] if len(self.at) else np.zeros(0, dtype=bool)
        self.first = np.flatnonzero(inside)  # nodes with an edge to the next one
        self.gaps = self.at[self.first + 1] - self.at[self.first]
        node = kmers[self.at] if len(self.at) else np.zeros(0, dtype=np.uint64)
        edge = N.mix(N.mix(node[self.first]) * np.uint64(0xC2B2AE3D27D4EB4F) + N.mix(node[self.first + 1] ^ self.gaps.astype(np.uint64)))
        if weaken:
            edge %= np.uint64(weaken)
        self.edge = (edge | np.uint64(1)).view(np.int64)  # 0 stands for none


def _edges(window: int, weaken: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys, rows = batch.column("doc_id").to_pylist(), batch.column("row").to_pylist(), []
            for part in N.slices(batch.column("text")):
                nodes = Nodes(part, window, weaken)
                place = nodes.at[nodes.first] - part.word_offsets[nodes.doc[nodes.first]]
                bounds = np.searchsorted(nodes.doc[nodes.first], np.arange(len(part) + 1))
                for d in np.flatnonzero(np.diff(bounds)).tolist():
                    for a in range(bounds[d], bounds[d + 1], PIECE):
                        b = min(a + PIECE, bounds[d + 1])
                        rows.append((ids[part.row + d], keys[part.row + d], nodes.edge[a:b], place[a:b].astype(np.int32), nodes.gaps[a:b].astype(np.int32), int(nodes.edge[a - 1]) if a > bounds[d] else 0, int(nodes.edge[b]) if b < bounds[d + 1] else 0))
            if rows:
                yield _rows(rows, EDGES)

    return run


def _rows(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32())}
    fields = [f.split(" ") for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(x, kinds[kind]) for x, (_, kind) in zip(zip(*rows), fields)], [name for name, _ in fields])


def _lists(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(name).flatten().to_numpy(zero_copy_only=False)


def _maybe_repeated(bits):
    """Of all edges those that may be repeated, with the edges before and after (0 for none)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = keyfilter.Filter(bits.value)
        for batch in batches:
            if not batch.num_rows:
                continue
            edge, at, gap = (_lists(batch, c) for c in ("edges", "at", "gaps"))
            n = np.diff(batch.column("edges").offsets.to_numpy())
            heads = np.cumsum(n) - n
            before, after = np.roll(edge, 1), np.roll(edge, -1)
            before[heads], after[heads + n - 1] = batch.column("before").to_numpy(), batch.column("after").to_numpy()
            keep = known.maybe([edge])
            doc, key = (np.repeat(batch.column(c).to_numpy(), n) for c in ("doc_id", "row"))
            yield pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in (doc, key, edge, at.astype(np.int32), gap.astype(np.int32), before, after)], ["doc_id", "row", "edge", "at", "gap", "before", "after"])

    return run


def compact(edges: DataFrame) -> DataFrame:
    """(edge, path, along) for edges (edge, gap, before, after): the path's first edge, and how many words the edge is behind it.

    ``before`` and ``after`` are the only edges around it in all its occurrences, or
    null.  A link holds if both sides say so.  Each round doubles how far back an
    edge points, so it takes the logarithm of the longest path's edges.
    """
    a, b = edges.select("edge", "gap", "before"), edges.select(F.col("edge").alias("b"), F.col("gap").alias("step"), F.col("after").alias("b_after"))
    linked = a.join(b, (F.col("before") == F.col("b")) & (F.col("edge") == F.col("b_after")), "left")
    found = table(linked.select("edge", F.coalesce("b", "edge").alias("path"), F.coalesce("step", F.lit(0)).cast("long").alias("along"), F.col("b").isNull().alias("head")), "links")
    while found.where("not head").take(1):
        ahead = found.select(F.col("edge").alias("p"), F.col("path").alias("to"), F.col("along").alias("more"), F.col("head").alias("ends"))
        # ``head``: the pointer is at a path's first edge; others jump by their pointer's own
        jumped = found.where("not head").join(ahead, F.col("path") == F.col("p")).select("edge", F.col("to").alias("path"), (F.col("along") + F.col("more")).alias("along"), F.col("ends").alias("head"))
        after = table(found.where("head").unionByName(jumped), "links")
        drop(found)
        found = after
    return found.select("edge", "path", "along")


def _joined_words(part: N.Slice, d: int) -> tuple[bytes, np.ndarray]:
    """The words of a document joined by one space, and where each begins (one more than words)."""
    lo, hi = part.word_offsets[d], part.word_offsets[d + 1]
    starts, ends = part.starts[lo:hi], part.ends[lo:hi]
    offsets = np.concatenate([[0], np.cumsum(ends - starts + 1)])
    if hi == lo:
        return b"", offsets
    data = part.data[starts[0] : ends[-1]]
    keep = ~N.IS_SPACE[data]
    if len(data) == int(offsets[-1]) - 1:  # one space between words, of some kind
        return np.where(keep, data, np.uint8(0x20)).tobytes(), offsets
    out = np.full(int(offsets[-1]) - 1, 0x20, dtype=np.uint8)
    out[N.ranges(offsets[:-1], ends - starts)] = data[keep]
    return out.tobytes(), offsets


def _digests(window: int, paths: bool, wanted=None):
    """Digests of the words of path occurrences (``paths``), and of windows all of whose edges are repeated but that no one path covers.

    With ``wanted`` (the bitmap of paths that fell apart) only of windows inside those.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        apart = keyfilter.Filter(wanted.value) if wanted else None
        for batch in batches:
            spans, ids, keys = batch.column("spans"), batch.column("doc_id").to_pylist(), batch.column("row").to_pylist()
            for part in N.slices(batch.column("text")):
                nodes = Nodes(part, window)
                rows = []
                edge_bounds = np.searchsorted(nodes.doc[nodes.first], np.arange(len(part) + 1))
                run_bounds = np.searchsorted(nodes.doc_of_run, np.arange(len(part) + 1))
                gap, k = sizes(window)
                for d in range(len(part)):
                    found = spans[part.row + d]
                    start, end, path = (found.values.field(c).to_numpy() for c in ("at", "end", "path"))
                    n = int(part.word_offsets[d + 1] - part.word_offsets[d])
                    if n < window:
                        continue
                    by = np.lexsort((end, start))
                    start, end, path = start[by], end[by], path[by]
                    first = np.arange(n - window + 1)
                    # the furthest end of spans that begin at or before a window
                    reach = np.concatenate([[0], np.maximum.accumulate(end)])[np.searchsorted(start, first, side="right")]
                    if apart is None:
                        inside = reach >= first + window
                        e = slice(edge_bounds[d], edge_bounds[d + 1])
                        from_ = nodes.at[nodes.first[e]] - part.word_offsets[d]
                        to = from_ + nodes.gaps[e] + k
                        repeated = np.concatenate([[0], np.maximum.accumulate(end)])[np.searchsorted(start, from_, side="right")] >= to
                        # edges between the nodes that a window picks at its start and at its end
                        node = nodes.node_of_run[run_bounds[d] : run_bounds[d + 1]]
                        base = nodes.node_of_run[run_bounds[d]]
                        once = np.concatenate([[0], np.cumsum(~repeated)])
                        head, tail = node[first] - base, node[first + window - k - gap + 1] - base
                        wanted_windows = np.flatnonzero(~inside & (once[tail] == once[head]) & (tail > head))
                    else:
                        gone = apart.maybe([path])
                        marks = np.zeros(n + 1, dtype=np.int64)
                        np.add.at(marks, start[gone], 1)
                        np.add.at(marks, np.maximum(end[gone] - window + 1, start[gone]), -1)
                        wanted_windows = np.flatnonzero(np.cumsum(marks[:-1])[: n - window + 1] > 0)
                    if not len(wanted_windows) and not paths:
                        continue
                    text, offsets = _joined_words(part, d)
                    at, doc, key = offsets.tolist(), ids[part.row + d], keys[part.row + d]
                    if paths:
                        rows += [(doc, key, s, p, hashlib.blake2b(text[at[s] : at[e] - 1], digest_size=16).digest()) for s, e, p in zip(start.tolist(), end.tolist(), path.tolist()) if e - s >= window]
                    rows += [(doc, key, s, None, hashlib.blake2b(text[at[s] : at[s + window] - 1], digest_size=16).digest()) for s in wanted_windows.tolist()]
                if rows:
                    yield _rows(rows, WINDOWS)

    return run


def repeated_paths(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, weaken: int = 0) -> DataFrame:
    """(doc_id, row, path, first, at, end): each occurrence of each compacted path of edges that occur in several documents; ``first`` is the path's least document.

    ``weaken`` makes edges collide, for tests.
    """
    spark = docs.sparkSession
    settle(spark)
    source = row_key(id_text(docs, id_col, text_col)).where("doc_id is not null and text is not null")
    every = table(source.mapInArrow(_edges(window, weaken), EDGES), "edges")
    several = table(every.select("doc_id", F.explode("edges").alias("edge")).groupBy("edge").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("last > first").select("edge"), "several")
    bits = spark.sparkContext.broadcast(keyfilter.build(several))
    drop(several)
    some = every.mapInArrow(_maybe_repeated(bits), "doc_id long, row long, edge long, at int, gap int, before long, after long")
    around = [F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.min("gap").alias("gap"), *(f(c).alias(f"{f.__name__}_{c}") for c in ("before", "after") for f in (F.min, F.max))]
    only = lambda c: F.when((F.col(f"min_{c}") == F.col(f"max_{c}")) & (F.col(f"min_{c}") != 0), F.col(f"min_{c}")).alias(c)
    edges = table(some.groupBy("edge").agg(*around).where("last > first").select("edge", "gap", "first", only("before"), only("after")), "repeated")
    paths = table(compact(edges).join(edges.select(F.col("edge").alias("e"), "first"), F.col("edge") == F.col("e")).drop("e"), "paths")
    drop(edges)
    free(spark)
    k = sizes(window)[1]
    found = some.select("doc_id", "row", "edge", "at", "gap").join(paths.withColumnRenamed("edge", "e"), F.col("edge") == F.col("e"))
    found = found.groupBy("doc_id", "row", "path", (F.col("at") - F.col("along")).cast("int").alias("base"))
    out = table(found.agg(F.min("first").alias("first"), F.min("at").alias("at"), F.max(F.col("at") + F.col("gap") + k).alias("end")).drop("base"), "occurrences")
    drop(every)
    drop(paths)
    bits.unpersist()
    free(spark)
    return out


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, weaken: int = 0) -> DataFrame:
    """Word spans (doc_id, row, spans array<struct<at,end>>) covered by windows that also start in a document with a smaller id.

    ``row`` is as ``row_key`` gives it, and tells rows of one doc_id apart only.  Rows without an id or text neither repeat nor are a source; rows that share an
    id are one document to each other, so they don't repeat each other.
    """
    spark = docs.sparkSession
    occurrences = repeated_paths(docs, id_col, text_col, window, weaken)
    per = table(occurrences.groupBy("doc_id", "row").agg(F.collect_list(F.struct("at", "end", "path")).alias("spans")), "paths")
    source = keyfilter.some(row_key(id_text(docs, id_col, text_col)).where("doc_id is not null and text is not null"), per.select("row"), "row")
    texts = table(source.join(per, ["doc_id", "row"]).select("doc_id", "row", "text", "spans"), "texts")
    digests = table(texts.mapInArrow(_digests(window, True), WINDOWS), "digests")
    drop(per)

    # words at the coordinates of each occurrence of a path against those of the others, the source's among them
    same = digests.where("path is not null").groupBy("path").agg(F.min("digest").alias("least"), F.max("digest").alias("most"))
    apart = table(same.where("least <> most").select("path"), "apart")
    whole = occurrences.where((F.col("end") - F.col("at") >= window) & (F.col("doc_id") > F.col("first")))
    windows = digests.where("path is null").select("doc_id", "row", "at", "digest")
    if apart.take(1):
        bits = spark.sparkContext.broadcast(keyfilter.build(apart))
        windows = windows.unionByName(texts.mapInArrow(_digests(window, False, bits), WINDOWS).select("doc_id", "row", "at", "digest"))
        whole = whole.join(apart, "path", "left_anti")
    first = table(windows.groupBy("digest").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("last > first").select(F.col("digest").alias("d"), "first"), "firsts")
    part = windows.join(first, (F.col("digest") == F.col("d")) & (F.col("doc_id") > F.col("first"))).select("doc_id", "row", "at", (F.col("at") + window).alias("end"))
    covered = whole.select("doc_id", "row", "at", "end").unionByName(part)
    # overlapping spans of a document become one, so that a document's list is short
    by = Window.partitionBy("doc_id", "row").orderBy("at", "end")
    marked = covered.withColumn("reach", F.max("end").over(by.rowsBetween(Window.unboundedPreceding, -1)))
    island = marked.withColumn("island", F.sum(F.when(F.col("reach") >= F.col("at"), 0).otherwise(1)).over(by.rowsBetween(Window.unboundedPreceding, 0)))
    merged = island.groupBy("doc_id", "row", "island").agg(F.min("at").alias("at"), F.max("end").alias("end"))
    out = table(merged.groupBy("doc_id", "row").agg(F.collect_list(F.struct("at", "end")).alias("spans")), "spans")
    for done in (occurrences, texts, digests, apart, first):
        drop(done)
    free(spark)
    return out


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        spans = batch.column("spans")
        rows: list[tuple[int, int, str]] = []
        for part in N.slices(batch.column("text")):
            data = part.data.tobytes()
            for d in range(len(part)):
                lo, hi = part.word_offsets[d], part.word_offsets[d + 1]
                n = int(hi - lo)
                starts, ends = part.starts[lo:hi], part.ends[lo:hi]
                found = spans[part.row + d]
                removed = 0
                if found.is_valid and n:
                    change = np.zeros(n + 1, dtype=np.int64)
                    np.add.at(change, found.values.field("at").to_numpy(), 1)
                    np.add.at(change, found.values.field("end").to_numpy(), -1)
                    keep = np.cumsum(change[:-1]) == 0
                    removed = int(n - keep.sum())
                    starts, ends = starts[keep], ends[keep]
                rows.append((n, removed, b" ".join([data[s:e] for s, e in zip(starts.tolist(), ends.tolist())]).decode()))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.string())], ["doc_id", "n_words", "n_removed", "kept"])


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, weaken: int = 0) -> DataFrame:
    """doc_id, n_words, n_removed and the kept words joined by one space, for each row.

    Null and empty texts have no words; texts under ``window`` words are kept
    whole; a row with a null id keeps all its words.  An empty table gives no rows.
    Only texts with repeated spans are shuffled to meet them.
    """
    source = row_key(id_text(docs, id_col, text_col))
    spans = repeated_spans(docs, id_col, text_col, window, weaken)
    schema = "doc_id long, n_words long, n_removed long, kept string"
    touched, others = keyfilter.split(source, spans.select("row"), "row")
    cut = touched.join(spans, ["doc_id", "row"], "left").select("doc_id", "text", "spans")
    return cut.unionByName(others.select("doc_id", "text", F.lit(None).cast("array<struct<at:int,end:int>>").alias("spans"))).mapInArrow(_cut, schema)


def digest(docs: DataFrame) -> DataFrame:
    """The contract's columns, from ``remove_repeats``."""
    return remove_repeats(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


ORACLE = r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), windows AS (
  SELECT doc_id, i AS pos, md5(array_to_string(list_slice(w, i, i + 49), ' ')) AS h
  FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 49)) AS i FROM words WHERE len(w) >= 50)
), firsts AS (SELECT h, min(doc_id) AS first FROM windows GROUP BY h
), hit AS (SELECT doc_id, list(pos) AS poss FROM windows JOIN firsts USING (h) WHERE doc_id > first GROUP BY doc_id
), cov AS (
  SELECT doc_id, list(DISTINCT p) AS gone
  FROM (SELECT doc_id, unnest(generate_series(a, a + 49)) AS p FROM (SELECT doc_id, unnest(poss) AS a FROM hit)) GROUP BY doc_id
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(len(gone), 0)::BIGINT AS n_removed,
       sha256(CASE WHEN gone IS NULL THEN array_to_string(w, ' ')
              ELSE coalesce(array_to_string(list_transform(list_filter(range(1, len(w) + 1), lambda i: NOT list_contains(gone, i)), lambda i: w[i]), ' '), '') END) AS kept_sha256
FROM words LEFT JOIN cov USING (doc_id)
"""
