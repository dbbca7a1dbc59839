"""URL filters: host rules, and character models of accepted and rejected URLs for the rest.

URLs that a rule decides are what the models learn from: variable-order Markov
models with Kneser-Ney smoothing.  Other URLs are judged by the difference of the
two log-likelihoods, normalised by length, against a threshold.  That is calibrated out
of fold on all URLs that a rule decides, each scored by a model that hasn't counted it; the models that
judge count all of them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sonarframe.llm import textnum as N
from sonarframe.llm.kneser_ney import SLICE_BYTES, Model, logistic_over, train
from sonarframe.llm.shared import named, table

#: (verdict, host, path)
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
#: Parts of the rule-decided URLs; each is scored by the counts of the others, and all of them calibrate.
FOLDS = 4


def host(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, _PARTS, 1), F.lit("")), _UPPER, _LOWER)


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _PARTS, 2), F.lit(""))


def matching_rule(host: Column, path: Column, rules=RULES) -> Column:
    """struct(rule, verdict) of the longest rule that fits, or null."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2])):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def _means(model: Model, column) -> np.ndarray:
    """Mean difference of log-probability over each text (0 for an empty one)."""
    out = [np.zeros(0)]
    for part, d in model.over(N.slices(column, limit=SLICE_BYTES)):
        sums = np.concatenate([[0], np.cumsum(d, dtype=np.float64)])
        out.append((sums[part.offsets[1:]] - sums[part.offsets[:-1]]) / np.maximum(np.diff(part.offsets), 1))
    return np.concatenate(out)


def judge(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict and ratio (mean log-likelihood difference, accepted minus rejected) of each row.

    A null URL, or one without ``://``, has an empty host and path, so no rule; it's
    judged by its characters like the rest.  If the rules decide no URL for one of
    the verdicts, or if accepted URLs aren't likelier under the model of accepted ones,
    there is nothing to go by and the rest are allowed.  Rows with a null
    page_id are judged like others, and repeated rows each for itself.  A very long URL counts whole.
    """
    url = named(url_col).cast("string")
    rows = pages.select(named(id_col).cast("long").alias("page_id"), url.alias("url"), host(url).alias("host"), path(url).alias("path"))
    rows = rows.withColumn("found", matching_rule(F.col("host"), F.col("path"), rules))
    decided = rows.where("found is not null").select(F.col("url").alias("text"), (F.col("found.verdict") == "allow").cast("int").alias("label"))
    decided = table(decided.withColumn("fold", F.pmod(F.xxhash64("text"), F.lit(FOLDS))), "decided")

    def scored(model: Model) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array(_means(model, batch.column("text")))], ["label", "ratio"])

        return run

    folds = []
    for i in range(FOLDS):
        apart = train(decided.where(F.col("fold") != i).select("text", "label"))
        folds.append(table(decided.where(F.col("fold") == i).mapInArrow(scored(apart), "label int, ratio double"), "ratios"))
        apart.unpersist()
    weights = logistic_over(reduce(DataFrame.unionByName, folds), "ratio", "label")
    model = train(decided.select("text", "label"))
    least = float(-weights[1] / weights[0]) if weights is not None and weights[0] > 0 else float("-inf")

    def ratios(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(_means(model, batch.column("url")))], [*batch.schema.names, "ratio"])

    out = rows.select("page_id", "url", "host", "path", "found.rule", F.col("found.verdict").alias("ruled"))
    out = out.mapInArrow(ratios, "page_id long, url string, host string, path string, rule string, ruled string, ratio double")
    return out.select("page_id", "host", "path", "rule", F.coalesce("ruled", F.when(F.col("ratio") >= least, "allow").otherwise("block")).alias("verdict"), "ratio")
