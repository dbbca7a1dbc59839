"""Text quality by votes of the nearest labelled texts in a latent-semantic space.

Terms are hashed byte pairs with square-root counts and inverse document
frequency, and a few shape terms (share of symbols and capitals, repeated words);
the latent space is the leading singular vectors of a bounded sample of labelled
rows.  The sample's vectors are broadcast; every text's vector is compared with all
of them in blocks, and the nearest vote with their label, weighted by similarity.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sonarframe.llm import textnum as N
from sonarframe.llm.shared import held_out, id_text, named, settle

TERMS, SHAPES, RANK = 2048, 8, 64
#: Labelled rows that are sampled, by hash of the id: what is fitted on and broadcast.
MAX_SAMPLE = 6144
NEIGHBOURS, SHARPNESS, BLOCK = 31, 8.0, 256
THRESHOLD = 0.3
#: Weight of the shape terms against the byte pairs, whose vector has length 1.
SHAPE_WEIGHT = 2.0

_PAIR = (N.mix(np.arange(65536, dtype=np.uint64) + np.uint64(1)) % np.uint64(TERMS)).astype(np.int64)
_LETTER = np.zeros(256, dtype=bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_CAPITAL = np.zeros(256, dtype=bool)
_CAPITAL[65:91] = True
_SYMBOL = ~_LETTER & ~N.IS_SPACE
_SYMBOL[48:58] = False
_SYMBOL[[44, 46]] = False


def terms(column) -> Iterator[np.ndarray]:
    """Rows of raw terms of consecutive texts: TERMS byte-pair counts and SHAPES shape terms."""
    for part in N.slices(column):
        n, d = len(part), part.data
        lengths = np.diff(part.offsets)
        doc = np.repeat(np.arange(n), lengths)
        out = np.zeros((n, TERMS + SHAPES), dtype=np.float32)
        if len(d) > 1:
            same = doc[1:] == doc[:-1]
            pair = _PAIR[(d[:-1].astype(np.int64) << 8) | d[1:]]
            out[:, :TERMS] = np.bincount((doc[:-1] * TERMS + pair)[same], minlength=n * TERMS).reshape(n, TERMS)
        some = np.maximum(lengths, 1)
        words = np.diff(part.word_offsets)
        share = lambda mask: np.bincount(doc[mask[d]], minlength=n) / some
        hashes, of = part.word_hashes(), part.doc_of_word()
        distinct = np.bincount(np.unique(np.column_stack([of, (hashes >> np.uint64(1)).astype(np.int64)]), axis=0)[:, 0], minlength=n) if len(of) else np.zeros(n)
        repeated = np.bincount(of[1:][(hashes[1:] == hashes[:-1]) & (of[1:] == of[:-1])], minlength=n) if len(of) else np.zeros(n)
        size = np.bincount(of, part.ends - part.starts, minlength=n) / np.maximum(words, 1)
        shapes = [share(_SYMBOL), share(_CAPITAL), share(_LETTER), 1 - distinct / np.maximum(words, 1), repeated / np.maximum(words, 1), np.minimum(size, 30) / 30, np.log1p(words) / 12, share(N.IS_SPACE)]
        out[:, TERMS:] = np.column_stack(shapes)
        yield out


class Space:
    """The fitted latent space with the labelled vectors in it."""

    def __init__(self, raw: np.ndarray, labels: np.ndarray, rank: int = RANK):
        pairs = raw[:, :TERMS]
        self.idf = np.log((1 + len(raw)) / (1 + (pairs > 0).sum(axis=0))).astype(np.float32) + 1
        self.centre, self.scale = raw[:, TERMS:].mean(axis=0), raw[:, TERMS:].std(axis=0) + 1e-6
        self.mean = np.zeros(TERMS + SHAPES, dtype=np.float32)
        weighted = self._weighted(raw)
        self.mean = weighted.mean(axis=0)
        weighted -= self.mean
        values, vectors = np.linalg.eigh((weighted.T @ weighted).astype(np.float64))
        self.axes = vectors[:, ::-1][:, :rank].astype(np.float32)
        self.vectors, self.labels = self._latent(raw), labels.astype(np.float32)

    def _weighted(self, raw: np.ndarray) -> np.ndarray:
        x = np.empty_like(raw, dtype=np.float32)
        x[:, :TERMS] = np.sqrt(raw[:, :TERMS]) * self.idf
        x[:, :TERMS] /= np.maximum(np.linalg.norm(x[:, :TERMS], axis=1, keepdims=True), 1e-9)
        x[:, TERMS:] = np.clip((raw[:, TERMS:] - self.centre) / self.scale, -4, 4) * (SHAPE_WEIGHT / SHAPES)
        return x - self.mean

    def _latent(self, raw: np.ndarray) -> np.ndarray:
        x = self._weighted(raw) @ self.axes
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)

    def vote(self, raw: np.ndarray) -> np.ndarray:
        """Exact cosines with all labelled vectors, in blocks of texts; the nearest vote by similarity."""
        out = np.empty(len(raw))
        k = min(NEIGHBOURS, len(self.labels))
        for i in range(0, len(raw), BLOCK):
            cosine = self._latent(raw[i : i + BLOCK]) @ self.vectors.T
            near = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
            least = np.take_along_axis(cosine, near, axis=1).min(axis=1, keepdims=True)
            for tied in np.flatnonzero((cosine >= least).sum(axis=1) > k):  # of equally near ones the first, by identifier
                near[tied] = np.argsort(-cosine[tied], kind="stable")[:k]
            weight = np.maximum(np.take_along_axis(cosine, near, axis=1), 1e-3) ** SHARPNESS
            out[i : i + BLOCK] = (weight * self.labels[near]).sum(axis=1) / weight.sum(axis=1)
        return np.clip(out, 0, 1)


def fit(docs: DataFrame, known: DataFrame, max_sample: int = MAX_SAMPLE) -> Space | None:
    """From docs (doc_id, text) and known (doc_id, label), of which a sample of bounded size is broadcast; None without rows."""
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row = 0
            for raw in terms(batch.column("text")):
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(row, len(raw)), batch.column("label").slice(row, len(raw)), pa.array([r.astype(np.float32).tobytes() for r in raw], pa.binary())], ["doc_id", "label", "raw"])
                row += len(raw)

    rows = docs.join(F.broadcast(chosen), "doc_id").select("doc_id", "label", "text").mapInArrow(run, "doc_id long, label int, raw binary")
    rows = rows.groupBy("doc_id").agg(F.min("label").alias("label"), F.min("raw").alias("raw")).toArrow()  # one text of each identifier
    if not rows.num_rows:
        return None
    by = np.argsort(rows.column("doc_id").to_numpy(), kind="stable")
    raw = np.frombuffer(b"".join(rows.column("raw").to_pylist()), dtype=np.float32).reshape(rows.num_rows, -1)[by]
    return Space(raw, rows.column("label").to_numpy()[by])


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of ``docs``.

    Learns from rows with a 0/1 label that aren't held out; a null text counts as
    empty, and empty texts are scored by the empty vector's neighbours.  Without any
    label every score is 0.5.  Of texts that share an id one is learnt from, of labels that do the lesser; of equally
    near neighbours those with smaller ids vote.  With labels of one class every text has it.  A very long text counts
    whole, as one vector; a row with a null id is held out and scored; repeated rows each have a row; an empty table gives none.
    """
    settle(docs.sparkSession)
    rows = id_text(docs, id_col, text_col)
    known = labels.select(named(id_col).cast("long").alias("doc_id"), named(label_col).cast("int").alias("label")).where("label in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.min("label").alias("label"))
    space = docs.sparkSession.sparkContext.broadcast(fit(rows, known.where(~held_out(F.col("doc_id")))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if space.value is None:
                p = np.full(batch.num_rows, 0.5)
            else:
                p = np.concatenate([np.zeros(0), *(space.value.vote(raw) for raw in terms(batch.column("text")))])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(p)], ["doc_id", "held_out", "score"])

    out = rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text").mapInArrow(run, "doc_id long, held_out boolean, score double")
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
