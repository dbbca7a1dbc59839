"""Selections in which an earlier or better row keeps others out: leaders of clusters, cuts with spacing.

Both are what a loop over sorted rows would select, in rounds that end in tables.  Leaders
are found block by block, as products of matrices: vectors of many coordinates have no cells that
would tell them apart.  Cuts go through buckets: one that nothing undecided nearby comes before
is selected, what it keeps out drops out, and the rest goes on.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sonarframe.operators.chunks import running_sum
from sonarframe.operators.matching import _buckets
from sonarframe.work import table

AXES = 3
#: Vectors of a key that are compared with one another in one group, and how many of them at a time.
BLOCK, STRIP = 1 << 13, 1 << 9


def _joined(left: DataFrame, right: DataFrame, keys: list[str], on: Column, how: str = "inner") -> DataFrame:
    """``right``'s keys are named __of_key; nulls are equal."""
    for k in keys:
        on &= F.col(k).eqNullSafe(F.col(f"__of_{k}"))
    return left.join(right, on, how)


def _renamed(rows: DataFrame, keys: list[str], *columns: Column) -> DataFrame:
    return rows.select(*(F.col(k).alias(f"__of_{k}") for k in keys), *columns)


def _close(a: np.ndarray, b: np.ndarray, near: float) -> np.ndarray:
    """Whether 1 - dot product is ``near`` at most, for all pairs; where rounding could decide, products are added one by one."""
    far = 1 - a @ b.T
    out = far <= near
    i, j = np.nonzero(np.abs(far - near) < 1e-9)
    for at in range(0, len(i), BLOCK):
        p, q = i[at : at + BLOCK], j[at : at + BLOCK]
        out[p, q] = 1 - np.cumsum(a[p] * b[q], axis=1)[:, -1] <= near
    return out


def _first_close(rows: np.ndarray, heads: np.ndarray, near: float) -> np.ndarray:
    """For each row the first of ``heads`` that is close, -1 if none is."""
    out = np.full(len(rows), -1)
    for at in range(0, len(rows), STRIP):
        close = _close(rows[at : at + STRIP], heads, near)
        out[at : at + STRIP] = np.where(close.any(axis=1), close.argmax(axis=1), -1)
    return out


def _first_come(rows: np.ndarray, near: float) -> np.ndarray:
    """For each of a block's rows, in order, the place of the first leader that is close: its own if it leads."""
    out = np.full(len(rows), -1)
    for at in range(0, len(rows), STRIP):
        strip = at + np.flatnonzero(out[at : at + STRIP] < 0)
        close = _close(rows[strip], rows[strip], near)
        for n, i in enumerate(strip):
            if out[i] < 0:
                kept_out = strip[n:][close[n, n:]]
                out[kept_out[out[kept_out] < 0]] = i
                out[i] = i
        heads, rest = strip[out[strip] == strip], at + STRIP + np.flatnonzero(out[at + STRIP :] < 0)
        if len(heads) and len(rest):
            found = _first_close(rows[rest], rows[heads], near)
            out[rest[found >= 0]] = heads[found[found >= 0]]
    return out


def _matrix(rows: pa.Table) -> np.ndarray:
    return rows["__v"].combine_chunks().flatten().to_numpy().reshape(len(rows), -1)


def leaders(rows: DataFrame, keys: list[str], order: str, vector: str, near: float, axes: int = AXES) -> DataFrame:
    """``rows`` with ``leader``, the ``order`` of the first leader of the key within ``near`` (1 - dot product).

    A row leads if no leader before it is as near; ``order`` is unique in a key, vectors are
    unit vectors (others, and null, lead themselves and nobody else).  A key's rows are cut, in order, into
    blocks of BLOCK.  A round takes the next block of every key: its rows are compared with the blocks of leaders
    before it, each in a group of its own, and those that none is near to among themselves.  A group holds two
    blocks; rounds are as many as the largest key has blocks.  ``axes`` is without effect.
    """
    length = F.aggregate(vector, F.lit(0.0), lambda s, v: s + v * v)
    unit = rows.where(F.abs(length - 1) < 1e-6).select(*keys, F.col(order).alias("__o"), F.transform(vector, lambda v: v.cast("double")).alias("__v"))
    on = [*keys, "__size"]
    placed = running_sum(unit.withColumn("__size", F.size("__v")), on, ["__o"], F.lit(1).cast("long"), "__i")
    known = placed.withColumn("__block", F.floor(F.col("__i") / BLOCK).cast("int")).drop("__i")
    known = table(known.repartitionByRange("__block", *on).sortWithinPartitions("__block", *on), "vectors")
    rounds = known.agg(F.max("__block")).first()[0]
    if rounds is None:
        return rows.withColumn("leader", F.col(order))
    kind = dict(known.dtypes)["__o"]
    names = [f"`{n}` {t}" for n, t in known.select(*on, "__o").dtypes]

    def compared(_, group):
        group = group.sort_by("__o")
        heads, asked = group.filter(pc.field("__head")), group.filter(~pc.field("__head"))
        if not len(heads) or not len(asked):
            return asked.select([*on, "__o"]).slice(0, 0).append_column("__leader", asked["__o"].slice(0, 0))
        first = _first_close(_matrix(asked), _matrix(heads), near)
        out = asked.select([*on, "__o"]).filter(pa.array(first >= 0))
        return out.append_column("__leader", heads["__o"].take(pa.array(first[first >= 0])))

    def decided(_, group):
        group = group.sort_by("__o")
        return group.append_column("__leader", group["__o"].take(pa.array(_first_come(_matrix(group), near))))

    found, heads = [], []
    for n in range(rounds + 1):
        block = known.where(F.col("__block") == n)
        if heads:
            asked = block.withColumn("__of", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn("__head", F.lit(False))
            given = reduce(DataFrame.unionByName, heads).withColumn("__of", F.col("__block")).withColumn("__head", F.lit(True))
            near_ones = given.unionByName(asked).groupBy(*on, "__of").applyInArrow(compared, ", ".join([*names, f"__leader {kind}"]))
            out = table(near_ones.groupBy(*on, "__o").agg(F.min("__leader").alias("__leader")), "kept-out")
            found.append(out)
            block = _joined(block, _renamed(out, on, F.col("__o").alias("__p")), on, F.col("__o") == F.col("__p"), "left_anti")
        done = table(block.groupBy(*on).applyInArrow(decided, ", ".join(f"`{c}` {t}" for c, t in [*known.dtypes, ("__leader", kind)])), "decided")
        found.append(done.select(*on, "__o", "__leader"))
        heads.append(done.where(F.col("__leader") == F.col("__o")).drop("__leader"))
    first = _renamed(reduce(DataFrame.unionByName, found), keys, F.col("__o").alias("__p"), F.col("__leader"))
    return _joined(rows, first, keys, F.col(order) == F.col("__p"), "left").select(*rows.columns, F.coalesce("__leader", order).alias("leader"))


def dedupe(hits: DataFrame, keys: list[str], order: str, vector: str, peak: str, near: float = 0.06, keep: int = 24, least: float = 0.08, axes: int = AXES) -> DataFrame:
    """The loudest hit of each cluster, and of these the ``keep`` loudest of a key; hits under ``least`` of the key's loudest are out before."""
    top = _renamed(hits.groupBy(*keys).agg(F.max(peak).alias("__top")), keys, F.col("__top"))
    loud = _joined(hits, top, keys, F.lit(True)).where((F.col(peak) >= F.col("__top") * least) | (F.col("__top") <= 0)).select(*hits.columns)
    clustered = leaders(loud, keys, order, vector, near, axes)
    best = clustered.groupBy(*keys, "leader").agg(F.min_by(F.struct(*hits.columns), F.struct(-F.col(peak), F.col(order))).alias("__best")).select("__best.*", "leader")
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col(peak).desc(), "leader"))
    return best.withColumn("__rank", rank).where(F.col("__rank") <= keep).select(*hits.columns)


def spaced(candidates: DataFrame, keys: list[str], at: str, score: str, spacing: float) -> DataFrame:
    """Candidates (distinct places of a key) taken best first, each at least ``spacing`` from all taken before; of equal scores the earlier first.

    A round takes every candidate that is the best of its own and the neighbouring buckets of ``spacing``.
    Rounds are as many as a run of rising scores has buckets.
    """
    width = spacing * (1 + 1e-12)
    rank = F.struct((-F.col(score)).alias("s"), F.col(at).alias("t"))
    open_rows = table(candidates.withColumn("__b", F.floor(F.col(at) / width).cast("long")), "candidates")
    taken, left = [], open_rows.count()
    while left:
        best = open_rows.groupBy(*keys, "__b").agg(F.min(rank).alias("__r"))
        around = best.select(*keys, "__r", F.explode(F.array(F.col("__b") - 1, F.col("__b"), F.col("__b") + 1)).alias("__n")).groupBy(*keys, "__n").agg(F.min("__r").alias("__least"))
        around = _renamed(around, keys, F.col("__n"), F.col("__least"))
        won = table(_joined(open_rows, around, keys, F.col("__b") == F.col("__n")).where(rank == F.col("__least")).select(*open_rows.columns), "won")
        taken.append(won)
        spread = _renamed(won, keys, F.col(at).alias("__w"), F.explode(F.array(F.col("__b") - 1, F.col("__b"), F.col("__b") + 1)).alias("__n"))
        kept_out = (F.col("__b") == F.col("__n")) & (F.abs(F.col(at) - F.col("__w")) < spacing)
        open_rows = table(_joined(open_rows, spread, keys, kept_out, "left_anti"), "candidates")
        left = open_rows.count()
    out = candidates.limit(0)
    for won in taken:
        out = out.unionByName(won.drop("__b"))
    return out


def boundary_scores(frames: DataFrame, onsets: DataFrame, keys: list[str], at: str, db: str, strength: str, back: int, deep: float, long: int, reference: int) -> DataFrame:
    """``onsets`` (keys, at, strength) with ``score``: how far levels fall in the ``back`` frames before, how long they stay down, and how hard the onset is.

    A frame is down if it's ``deep`` dB or more under the mean of the ``reference`` frames up to it; falls count in
    ``deep``, runs in ``long`` frames, and strength in the key's 75th percentile, up to 2.  Places are integers.
    """
    w = Window.partitionBy(*keys).orderBy(at)
    level = F.avg(F.when(F.col(db) > -180, F.col(db))).over(w.rowsBetween(1 - reference, 0))
    f = frames.select(*keys, F.col(at).alias("__i"), F.col(db).alias("__db"), F.coalesce(level, F.lit(-180.0)).alias("__ref"))
    v = Window.partitionBy(*keys).orderBy("__i")
    up = F.max(F.when(F.col("__db") > F.col("__ref") - deep, F.col("__i"))).over(v.rowsBetween(Window.unboundedPreceding, 0))
    f = f.withColumn("__first", F.coalesce(F.min("__i").over(v.rowsBetween(Window.unboundedPreceding, 0)), F.col("__i")) - 1).withColumn("__up", up)
    f = f.withColumn("__down", F.col("__i") - F.coalesce("__up", "__first")).withColumn("__bucket", F.floor(F.col("__i") / back).cast("long"))
    asked = _renamed(onsets, keys, F.col(at).alias("__t"), F.explode(F.sequence(F.floor((F.col(at) - back) / back).cast("long"), F.floor(F.col(at) / back).cast("long"))).alias("__n"))
    met = _joined(f, asked, keys, F.col("__bucket") == F.col("__n")).where((F.col("__i") >= F.col("__t") - back) & (F.col("__i") <= F.col("__t")))
    before = F.col("__i") < F.col("__t")
    run = F.least(F.col("__down"), F.col("__i") - (F.col("__t") - back) + 1)
    sums = met.groupBy(*keys, "__t").agg(F.min(F.when(before, F.col("__db"))).alias("__low"), F.max(F.when(before, run)).alias("__run"), F.max(F.when(~before, F.col("__ref"))).alias("__here"))
    counts = onsets.groupBy(*keys, F.col(strength).alias("__s")).agg(F.count("*").alias("__n"))
    upto = F.sum("__n").over(Window.partitionBy(*keys).orderBy("__s"))
    counts = counts.withColumn("__upto", upto).withColumn("__all", F.sum("__n").over(Window.partitionBy(*keys)))
    typical = counts.where(F.col("__upto") > F.floor((F.col("__all") - 1) * 0.75)).groupBy(*keys).agg(F.greatest(F.lit(1e-6), F.min("__s")).alias("__typical"))
    found = _joined(onsets, _renamed(typical, keys, F.col("__typical")), keys, F.lit(True)).select(*onsets.columns, "__typical")
    found = _joined(found, _renamed(sums, keys, F.col("__t"), F.col("__low"), F.col("__run"), F.col("__here")), keys, F.col(at) == F.col("__t"), "left")
    dip = F.greatest(F.lit(0.0), F.col("__here") - F.col("__low")) / deep
    rise = F.least(F.lit(2.0), F.col(strength) / F.col("__typical"))
    return found.select(*onsets.columns, F.when(F.col("__low").isNull(), 0.0).otherwise(dip + rise + F.col("__run") / long).alias("score"))


def cut_long(pieces: DataFrame, candidates: DataFrame, frames: DataFrame, keys: list[str], at: str, score: str, value: str, shortest: float, longest: float, preferred: float) -> DataFrame:
    """Pieces (keys, start, end), those over ``longest`` cut until none is.

    A cut goes to the candidate with the best score less its distance from the wanted place (in ``longest``),
    ``preferred`` after the start or in the middle, ``shortest`` from both ends; without one, to the frame with the
    lowest value there, or the wanted place.  A task holds the candidates and frames of one long piece.
    """
    long = table(pieces.where(F.col("end") - F.col("start") > longest).withColumn("__piece", F.monotonically_increasing_id()), "long")
    if not long.take(1):
        return pieces
    spread = _renamed(long, keys, F.col("__piece"), F.col("start").alias("__a"), F.col("end").alias("__z"), _buckets(F.col("start"), F.col("end"), longest).alias("__n"))

    def within(rows: DataFrame, number: str, kind: int) -> DataFrame:
        placed = rows.select(*keys, F.col(at).cast("double").alias("t"), F.col(number).cast("double").alias("v"), F.floor(F.col(at) / longest).cast("long").alias("__b"))
        return _joined(placed, spread, keys, F.col("__b") == F.col("__n")).where((F.col("t") >= F.col("__a")) & (F.col("t") <= F.col("__z"))).select("__piece", "t", "v", F.lit(kind).alias("kind"))

    whole = long.select("__piece", F.col("start").alias("t"), F.col("end").alias("v"), F.lit(0).alias("kind"))
    rows = whole.unionByName(within(candidates, score, 1)).unionByName(within(frames, value, 2))

    def run(_, rows):
        rows = rows.sort_by("t")
        kind, t, v = (rows[c].to_numpy() for c in ("kind", "t", "v"))
        (start,), (end,) = t[kind == 0], v[kind == 0]
        own, scores, levels_at, levels = t[kind == 1], v[kind == 1], t[kind == 2], v[kind == 2]
        ends = [float(start), float(end)]
        i = 0
        while i < len(ends) - 1:
            length = ends[i + 1] - ends[i]
            if length <= longest:
                i += 1
                continue
            target, low, high = ends[i] + min(preferred, length / 2), ends[i] + shortest, ends[i + 1] - shortest
            a, b = np.searchsorted(own, low), np.searchsorted(own, high, side="right")
            c, d = np.searchsorted(levels_at, low), np.searchsorted(levels_at, high, side="right")
            if b > a:
                cut = own[a + np.argmax(scores[a:b] - np.abs(own[a:b] - target) / longest)]
            elif d > c:
                cut = levels_at[c + np.argmin(levels[c:d])]
            else:
                cut = target
            if not ends[i] < cut < ends[i + 1]:
                i += 1  # nothing can be cut off here
                continue
            ends.insert(i + 1, float(cut))
        return pa.table({"__piece": pa.array([rows["__piece"][0].as_py()] * (len(ends) - 1), pa.int64()), "__s": ends[:-1], "__e": ends[1:]})

    cut = rows.groupBy("__piece").applyInArrow(run, "__piece long, __s double, __e double")
    parts = long.join(cut, "__piece").select(*keys, F.col("__s").alias("start"), F.col("__e").alias("end"))
    short = pieces.where(F.col("end") - F.col("start") <= longest).select(*keys, F.col("start").cast("double").alias("start"), F.col("end").cast("double").alias("end"))
    return short.unionByName(parts)
