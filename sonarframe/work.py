"""Work tables in the folder that a cluster shares (``spark.checkpoint.dir``)."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"


def folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; where it is unset, a temporary one on a single machine, and an error on a cluster."""
    found = spark.conf.get(SETTING, None) or spark.sparkContext.getConf().get(SETTING)
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError(f"{SETTING} must name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="sonarframe-")
        spark.conf.set(SETTING, found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{folder(spark)}/sonarframe-{name}-{uuid.uuid4().hex}"


def table(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to a new work table and read back: an action whose rows don't change any more."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
