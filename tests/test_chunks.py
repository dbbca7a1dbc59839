"""Ordered operators give one result for every size of chunk and number of tasks."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sonarframe.operators import chunks


def greedy(times, spacing):
    out = []
    for t in sorted(times):
        if not out or t - out[-1] >= spacing:
            out.append(t)
    return out


@pytest.mark.parametrize("chunk", [1, 2, 8, 1 << 16])
def test_debounce(spark, chunk):
    draw = random.Random(chunk)
    rows = [("hot", draw.choice([0.1, 0.25, 1.0]) * draw.randrange(2000)) for _ in range(700)] + [(None, 0.1 * i) for i in range(30)] + [("one", 5.0), ("nan", None)]
    got = chunks.debounce(spark.createDataFrame(rows, "k string, t double").repartition(7), ["k"], "t", 0.7, chunk)
    assert got.columns == ["k", "t"]
    found = sorted(((r.k or "", r.t) for r in got.collect()))
    assert found == sorted((k or "", t) for k in ("hot", None, "one") for t in greedy([t for x, t in rows if x == k], 0.7))
    if chunk == 8:
        placed = chunks.numbered(spark.createDataFrame(rows, "k string, t double"), ["k"], ["t"], 8)
        assert placed.where("k = 'hot'").select("__chunk").distinct().count() > 80  # one key in many groups


def test_running_sum(spark):
    rows = [(i % 3 or None, i, i * i % 17) for i in range(400)]
    got = chunks.running_sum(spark.createDataFrame(rows, "k int, i int, v long").repartition(5), ["k"], ["i"], F.col("v"), "before", 16)
    want = []
    for k in (None, 1, 2):
        own = [(i, v) for x, i, v in rows if x == k]
        want += [(k, i, v, sum(w for j, w in own if j < i)) for i, v in own]
    assert sorted((r.k or 0, r.i, r.v, r.before) for r in got.collect()) == sorted((k or 0, *x) for k, *x in want)


def test_chunks_are_powers_of_two(spark):
    with pytest.raises(ValueError):
        chunks.numbered(spark.range(3).toDF("t"), [], ["t"], 3)


def test_next_kept_follows_the_difference():
    times = np.array([0.0, 0.1, 0.2, 0.30000000000000004, 0.4])
    for last in times:
        want = next((i for i, t in enumerate(times) if t - last >= 0.1), len(times))
        assert chunks._next_kept(times, np.array([last]), 0.1)[0] == want


def test_short_keys_share_a_chunk(spark):
    """Groups are as many as chunks, however many keys there are; a key in the middle of a chunk begins afresh."""
    rows = [(k, i, float(k + i)) for k in range(90) for i in range(1 + k % 7)] + [(None, i, 1.0) for i in range(70)]
    placed = chunks.numbered(spark.createDataFrame(rows, "k int, i int, v double"), ["k"], ["i"], 64)
    asked = spark.sparkContext.accumulator(0)

    def summarise(part):
        asked.add(1)
        return {"sum": pa.array([sum(part["v"].to_pylist())])}

    def combine(part):
        return {"before": pa.array(np.concatenate([[0.0], np.cumsum(part["sum"].to_numpy())[:-1]]))}

    got = chunks.carried(placed, ["k"], summarise, "sum double", combine, "before double", lambda part: {"total": pa.array(part["before"][0].as_py() + np.cumsum(part["v"].to_numpy()))}, "total double")
    found = {(r.k, r.i): r.total for r in got.collect()}
    assert found == {(k, i): float(sum(v for q, j, v in rows if q == k and j <= i)) for k, i, _ in rows}
    assert asked.value <= 3 * placed.select("__chunk").distinct().count() < 90
