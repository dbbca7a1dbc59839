"""Operators along an order whose steps depend on those before, without a whole key in one task.

Rows are sorted by key and order in ranges and cut into chunks of at most ``CHUNK``
rows.  Each chunk is summed up on its own (what comes out of it for whatever goes
in), the summaries of a key are combined in order, and each chunk is then worked
through with what goes into it.  A task holds one chunk, or the summaries of one key: a 65,536th of its rows.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sonarframe.work import table

CHUNK = 1 << 16


def numbered(rows: DataFrame, keys: list[str], order: list[str], chunk: int = CHUNK) -> DataFrame:
    """``rows`` as a table with ``__place``, which rises along keys and order, and ``__chunk``; ``chunk`` is a power of two."""
    if chunk & (chunk - 1) or not 0 < chunk <= 1 << 33:
        raise ValueError("a chunk is a power of two")
    sorted_rows = rows.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order)
    placed = table(sorted_rows.withColumn("__place", F.monotonically_increasing_id()), "numbered")
    return placed.withColumn("__chunk", F.shiftright("__place", chunk.bit_length() - 1))


def _schema(rows: DataFrame, names: list[str], more: str) -> str:
    kinds = dict(rows.dtypes)
    return ", ".join([*(f"`{n}` {kinds[n]}" for n in names), more])


def _with(rows: pa.Table, names: list[str], n: int, columns: dict[str, pa.Array]) -> pa.Table:
    """A table of n rows: the first values of ``names``, and ``columns``."""
    same = rows.select(names).slice(0, 1).take(pa.array(np.zeros(n, dtype=np.int64)))
    for name, values in columns.items():
        same = same.append_column(name, values)
    return same


def carried(
    placed: DataFrame, keys: list[str],
    summarise: Callable[[pa.Table], dict[str, pa.Array]], summary: str,
    combine: Callable[[pa.Table], dict[str, pa.Array]], carry: str,
    apply: Callable[[pa.Table], dict[str, pa.Array]], result: str,
) -> DataFrame:
    """``placed`` (``numbered``) with the columns of ``apply``.

    A group is a chunk, with the rows of many keys where these are short; only a chunk's first and last key can go on in
    others, so only these are summed up.  What ``combine`` gives for a key's first summary mustn't depend on it.
    summarise: a chunk's rows in order -> one row of ``summary``.  combine: a key's
    summaries in order -> for each what goes into it, ``carry``.  apply: a chunk's rows in
    order, with the columns of ``carry`` in each -> ``result``, a value a row.
    """

    def segments(rows):
        """A chunk's rows in order, cut where the key changes."""
        rows = rows.sort_by("__place")
        cuts = np.zeros(max(0, len(rows) - 1), dtype=bool)
        for k in keys:
            codes = rows[k].combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
            cuts |= codes[1:] != codes[:-1]
        ends = [0, *(np.flatnonzero(cuts) + 1).tolist(), len(rows)]
        return [rows.slice(i, j - i) for i, j in zip(ends, ends[1:])]

    def summed(_, rows):
        parts = segments(rows)
        return pa.concat_tables([_with(p, [*keys, "__chunk"], 1, summarise(p)) for p in (parts if len(parts) < 3 else (parts[0], parts[-1]))])

    def combined(_, rows):
        rows = rows.sort_by("__chunk")
        out = rows.select([*keys, "__chunk"])
        for name, values in combine(rows).items():
            out = out.append_column(name, values)
        return out

    def applied(rows, carries):
        parts, out = segments(rows), []
        of = {tuple(c[k] for k in keys): i for i, c in enumerate(carries.select(keys).to_pylist())}
        fresh = pa.table(combine(pa.table(summarise(parts[0])))) if len(parts) > 2 else None  # what goes into a key's first chunk, whatever its summary
        for i, p in enumerate(parts):
            edge = i in (0, len(parts) - 1)
            before = carries.slice(of[tuple(p[k][0].as_py() for k in keys)], 1) if edge else fresh.slice(0, 1)
            before, done = before.select(names).take(pa.array(np.zeros(len(p), dtype=np.int64))), p.select(kept)
            given = done
            for name in names:
                given = given.append_column(name, before[name])
            for name, values in apply(given).items():
                done = done.append_column(name, values)
            out.append(done)
        return pa.concat_tables(out)

    kept = placed.columns
    # no function of a group runs twice: what is combined is a table
    chunks = table(placed.groupBy("__chunk").applyInArrow(summed, _schema(placed, [*keys, "__chunk"], summary)), "summaries")
    carries = table(chunks.groupBy(*keys).applyInArrow(combined, _schema(placed, [*keys, "__chunk"], carry)), "carries")
    names = [c for c in carries.columns if c not in (*keys, "__chunk")]
    return placed.groupBy("__chunk").cogroup(carries.groupBy("__chunk")).applyInArrow(applied, _schema(placed, kept, result))


def running_sum(rows: DataFrame, keys: list[str], order: list[str], value: Column, out: str, chunk: int = CHUNK) -> DataFrame:
    """The sum of ``value`` over the rows of the key before each one (0 for the first): sums within chunks, and of the chunks before."""
    placed = numbered(rows.withColumn("__value", value), keys, order, chunk)
    sums = placed.groupBy(*keys, "__chunk").agg(F.sum("__value").alias("__sum"))
    before = F.sum("__sum").over(Window.partitionBy(*keys).orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1))
    sums = sums.withColumn("__before", F.coalesce(before, F.lit(0))).select(*(F.col(k).alias(f"__of_{k}") for k in keys), F.col("__chunk").alias("__of_chunk"), "__before")
    same = F.col("__chunk") == F.col("__of_chunk")
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"__of_{k}"))
    within = F.sum("__value").over(Window.partitionBy(*keys, "__chunk").orderBy("__place").rowsBetween(Window.unboundedPreceding, -1))
    return placed.join(sums, same).withColumn(out, F.col("__before") + F.coalesce(within, F.lit(0))).drop("__before", "__value", "__place", "__chunk", "__of_chunk", *(f"__of_{k}" for k in keys))


def _next_kept(times: np.ndarray, last, spacing: float) -> np.ndarray:
    """The first place in sorted ``times`` that is ``spacing`` or more after each of ``last``."""
    n = len(times)
    at = np.searchsorted(times, last + spacing)
    while True:  # as the differences round, past equal times
        back, here = np.maximum(at - 1, 0), np.minimum(at, n - 1)
        early, late = (at > 0) & (times[back] - last >= spacing), (at < n) & (times[here] - last < spacing)
        if not (early | late).any():
            return at
        at = at + late - (early & ~late)


def debounce(rows: DataFrame, keys: list[str], at: str, spacing: float, chunk: int = CHUNK) -> DataFrame:
    """Rows of a key that are at least ``spacing`` after the last one kept; the first is kept.

    A chunk's summary says for each row that may be the first one kept in it, all within a
    spacing of its start, which is then the last: successors are followed by pointer doubling.
    Of rows at one time one stays; a null time is dropped.
    """
    placed = numbered(rows.where(F.col(at).isNotNull()).withColumn("__at", F.col(at).cast("double")), keys, ["__at"], chunk)

    def summarise(rows: pa.Table) -> dict[str, pa.Array]:
        t = rows["__at"].to_numpy()
        to, n = _next_kept(t, t, spacing), len(t)
        to = np.where(to < n, to, np.arange(n))
        for _ in range(n.bit_length()):
            to = to[to]
        first = int(_next_kept(t, t[:1], spacing)[0])
        entries = np.arange(min(first, n - 1) + 1)
        return {"entries": pa.array([t[entries]], pa.list_(pa.float64())), "exits": pa.array([t[to[entries]]], pa.list_(pa.float64()))}

    def combine(rows: pa.Table) -> dict[str, pa.Array]:
        last, out = -np.inf, []
        for entries, exits in zip(rows["entries"].to_pylist(), rows["exits"].to_pylist()):
            out.append(last)
            entry = int(_next_kept(np.array(entries), np.array([last]), spacing)[0])
            last = exits[entry] if entry < len(entries) else last
        return {"last": pa.array(out, pa.float64())}

    def apply(rows: pa.Table) -> dict[str, pa.Array]:
        t = rows["__at"].to_numpy()
        to, kept = _next_kept(t, t, spacing).tolist(), np.zeros(len(t), dtype=bool)
        i = int(_next_kept(t, rows["last"].to_numpy()[:1], spacing)[0])
        while i < len(t):
            kept[i] = True
            i = to[i]
        return {"__kept": pa.array(kept)}

    found = carried(placed, keys, summarise, "entries array<double>, exits array<double>", combine, "last double", apply, "__kept boolean")
    return found.where("__kept").select(*rows.columns)
