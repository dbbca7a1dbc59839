"""Seeded draws that are the same under any partitioning: a row's number comes from its own values.

A draw is md5 of seed, salt and the row's key, so that other engines can repeat it.  Choices go
through keys that rise with exponential waiting times (Efraimidis and Spirakis, 2006): the
least of them is a weighted choice, and the k least are one without replacement.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sonarframe.functions.columns import col
from sonarframe.operators.chunks import CHUNK, running_sum

_DIGITS = 13  # 52 bits: all are exact in a double


def uniform(seed, *key, salt: str = "") -> Column:
    """A number within 0..1 (1 excluded) for the seed (a value or a column) and the values of ``key``, given as text; null counts as ''."""
    parts = [F.coalesce(k.cast("string"), F.lit("")) for k in (seed if isinstance(seed, Column) else F.lit(seed), *map(col, key))]
    bits = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(salt), *parts)), 1, _DIGITS), 16, 10)
    return bits.cast("long").cast("double") / float(1 << (4 * _DIGITS))


def waiting(u: Column, weight) -> Column:
    """The waiting time of an event of rate ``weight``; null where the weight isn't positive."""
    w = col(weight).cast("double")
    return F.when(w > 0, -F.ln(1 - u) / w)


def pick(rows: DataFrame, keys: list[str], weight: str, identity: list[str], seed) -> DataFrame:
    """One row of each key, drawn by weight: an aggregation, whatever the size of a key.  Keys without a positive weight have none."""
    drawn = rows.withColumn("__wait", waiting(uniform(seed, *keys, *identity, salt="pick"), weight)).where(F.col("__wait").isNotNull())
    return drawn.groupBy(*keys).agg(F.min_by(F.struct(*rows.columns), F.struct("__wait", *identity)).alias("__row")).select("__row.*")


def sample(rows: DataFrame, keys: list[str], weight: str, identity: list[str], k: int, seed, lists: int = 32) -> DataFrame:
    """``k`` rows of each key without replacement, drawn by weight one after another: ``rows`` with ``draw`` from 1.

    The first ``k`` of each of a key's lists are chosen before those of the key, so no task sorts a whole key.
    """
    drawn = rows.withColumn("__wait", waiting(uniform(seed, *keys, *identity, salt="pick"), weight)).where(F.col("__wait").isNotNull())
    drawn = drawn.withColumn("__list", F.pmod(F.xxhash64(*identity), F.lit(lists)))
    first = F.row_number().over(Window.partitionBy(*keys, "__list").orderBy("__wait", *identity))
    few = drawn.withColumn("draw", first).where(F.col("draw") <= k)
    return few.withColumn("draw", F.row_number().over(Window.partitionBy(*keys).orderBy("__wait", *identity))).where(F.col("draw") <= k).drop("__wait", "__list")


def shuffled(rows: DataFrame, keys: list[str], identity: list[str], seed, chunk: int = CHUNK) -> DataFrame:
    """``rows`` with ``place`` from 0: each key's rows in an order drawn by the seed, counted by chunks."""
    drawn = rows.withColumn("__u", uniform(seed, *keys, *identity, salt="shuffle"))
    return running_sum(drawn, keys, ["__u", *identity], F.lit(1).cast("long"), "place", chunk).drop("__u")


def choose(seed, key, options: list, weights: list[float], salt: str = "") -> Column:
    """One of a few options for each row, by weight: where the draw falls among the sums of weights."""
    total = float(sum(weights))
    if len(options) != len(weights) or not options or min(weights) < 0 or total <= 0:
        raise ValueError("options need weights, one of them positive")
    u, upto, out = uniform(seed, *key, salt=salt) * total, 0.0, None
    for option, weight in zip(options, weights):
        upto += weight
        if weight:
            out = F.when(u < upto, F.lit(option)) if out is None else out.when(u < upto, F.lit(option))
    return out.otherwise(F.lit([o for o, w in zip(options, weights) if w][-1]))
