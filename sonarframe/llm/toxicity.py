"""Toxicity by the difference of class-conditional Kneser-Ney log-likelihoods.

A toxic expression is a few words in a long ordinary text, so likelihoods are
normalised by length over passages: the score rests on the largest mean
difference over ``PASSAGES`` bytes, and over the whole text, turned into a
probability by a logistic regression.  Its weights are fitted out of fold, on rows that
the counts of a first model haven't seen; the model that scores counts all labelled rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sonarframe.llm import keyfilter
from sonarframe.llm import textnum as N
from sonarframe.llm.kneser_ney import SHARD_GRAMS, SLICE_BYTES, Model, logistic, train
from sonarframe.llm.shared import MOST_IDS, held_out, id_text, named, settle, table, without

#: Lengths in bytes over which differences are averaged.
PASSAGES = (6, 10, 16, 32)
#: Labelled rows at most for the weights and intercept of the calibration (the counts take all rows).
MAX_CALIBRATION = 20_000
FEATURES = len(PASSAGES) + 2


def features(model: Model, column) -> Iterator[tuple[int, np.ndarray]]:
    """(first row, matrix) for consecutive texts: largest passage means, mean over the text, and log of the length."""
    for part, d in model.over(N.slices(column, limit=SLICE_BYTES)):
        d = d.astype(np.float64)
        sums = np.concatenate([[0], np.cumsum(d)])
        lengths = np.diff(part.offsets)
        out = np.zeros((len(part), FEATURES))
        some = lengths > 0
        heads = part.offsets[:-1][some]
        for i, width in enumerate(PASSAGES):
            if not len(d):
                break
            passages = np.empty(len(d))
            passages[width - 1 :] = sums[width:] - sums[:-width]
            early = np.minimum(lengths[some], width - 1)  # passages that would begin before their text
            at = N.ranges(heads, early)
            passages[at] = sums[at + 1] - np.repeat(sums[heads], early)
            out[some, i] = np.maximum.reduceat(passages, heads) / width
        out[:, -2] = (sums[part.offsets[1:]] - sums[part.offsets[:-1]]) / np.maximum(lengths, 1)
        out[:, -1] = np.log1p(lengths)
        yield part.row, out


class Classifier:
    """Features to a probability; a text's length counts as the nearest one among those calibrated on."""

    def __init__(self, model: Model, weights: np.ndarray, centre: np.ndarray, scale: np.ndarray, lengths: tuple[float, float] = (-np.inf, np.inf)):
        self.model, self.weights, self.centre, self.scale, self.lengths = model, weights, centre, scale, lengths

    def scores(self, column) -> np.ndarray:
        rows = [x for _, x in features(self.model, column)]
        x = np.concatenate([np.zeros((0, FEATURES)), *rows])
        x[:, -1] = np.clip(x[:, -1], *self.lengths)
        x = (x - self.centre) / self.scale
        return 1 / (1 + np.exp(-np.clip(x @ self.weights[:-1] + self.weights[-1], -30, 30)))


def fit(docs: DataFrame, known: DataFrame, shard_grams: int = SHARD_GRAMS) -> Classifier | None:
    """From docs (doc_id, text) and known (doc_id, label): counts of all labelled rows, weights from a sample scored by counts of three quarters of the others.

    None if the calibration lacks a class.  Up to MOST_IDS labels are broadcast to their texts; beyond that only
    labelled texts are shuffled.  The sample's identifiers are few enough to broadcast.
    """
    part = F.pmod(F.xxhash64("doc_id"), F.lit(4))
    known = table(known, "labels")
    few = known.count() <= MOST_IDS

    def counted(some: DataFrame) -> Model:
        labelled = docs.join(F.broadcast(some), "doc_id") if few else keyfilter.some(docs, some.select("doc_id")).join(some, "doc_id")
        return train(labelled, shard_grams=shard_grams)

    apart = counted(known.where(part > 0))
    sample = known.where(part == 0).orderBy(F.xxhash64(F.col("doc_id") + 1), "doc_id").limit(MAX_CALIBRATION)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, x in features(apart, batch.column("text")):
                yield pa.RecordBatch.from_arrays([batch.column("label").slice(row, len(x)), pa.array(x.tolist(), pa.list_(pa.float64()))], ["label", "x"])

    rows = docs.join(F.broadcast(sample), "doc_id").select("text", "label").mapInArrow(run, "label int, x array<double>").toArrow()
    apart.unpersist()
    y = np.array(rows.column("label").to_pylist(), dtype=np.float64)
    if not len(y) or y.min() == y.max():
        return None
    x = np.array(rows.column("x").to_pylist())
    centre, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    return Classifier(counted(known), logistic((x - centre) / scale, y), centre, scale, (x[:, -1].min(), x[:, -1].max()))


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", threshold: float = 0.5, train_docs: DataFrame | None = None) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of ``docs``.

    Learns from the rows of ``train_docs`` (or ``docs``) that have a 0/1 label and aren't held out.  Null
    and empty texts are scored as texts without passages.  If either class is missing
    in the labels, or among those that calibrate, every score is 0.  A very long text counts whole, in one slice, and its length as the
    longest one calibrated on; a row with a null id is held out and scored; repeated rows each have a row; an empty table gives none.
    """
    settle(docs.sparkSession)
    rows = id_text(docs, id_col, text_col)
    known = labels.select(named(id_col).cast("long").alias("doc_id"), named(label_col).cast("int").alias("label")).where("label in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("label").alias("label"))
    source = id_text(train_docs, id_col, text_col) if train_docs is not None else rows
    classifier = fit(source.where("text is not null"), known.where(~held_out(F.col("doc_id"))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = classifier.scores(batch.column("text")) if classifier else np.zeros(batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(p)], ["doc_id", "held_out", "score"])

    out = rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text").mapInArrow(run, "doc_id long, held_out boolean, score double")
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_clean(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of ``docs`` that aren't rejected, with all their columns.

    Rows with a null id stay; rows that share an id go together if one of them is rejected.  An empty table stays empty, and
    without labels of both classes nothing is rejected.  Very long texts are scored whole.
    """
    gone = score(docs, labels, id_col, text_col).where("predicted = 1").select("doc_id").distinct()
    return without(docs, gone, id_col)
