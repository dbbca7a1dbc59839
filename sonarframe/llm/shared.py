"""Work tables in the folder that the cluster shares, and column helpers."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SETTING = "spark.checkpoint.dir"
#: Rows and bytes of an Arrow batch: texts are long.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": "2000", "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20)}
#: For glibc, Arrow and the tokenizer in Python workers: freed memory goes back to the system, and a worker is one thread.
WORKER = {"MALLOC_ARENA_MAX": "1", "MALLOC_MMAP_THRESHOLD_": str(1 << 18), "MALLOC_TRIM_THRESHOLD_": str(1 << 18), "ARROW_DEFAULT_MEMORY_POOL": "system", "TOKENIZERS_PARALLELISM": "false"}
#: Identifiers that may be broadcast to leave rows out: 16 MB.
MOST_IDS = 1 << 21


def settle(spark: SparkSession) -> None:
    """Smaller Arrow batches, unless the session has its own, and workers that give memory back."""
    for name, value in BATCH.items():
        if spark.conf.get(name, None) is None:
            spark.conf.set(name, value)
    for name, value in WORKER.items():
        spark.sparkContext.environment.setdefault(name, value)


def free(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of plans that nothing holds any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; where it is unset, a temporary one on a single machine, and an error on a cluster."""
    found = spark.conf.get(SETTING, None) or spark.sparkContext.getConf().get(SETTING)
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError(f"{SETTING} must name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="sonarframe-")
        spark.conf.set(SETTING, found)
    return found.rstrip("/")


def work_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/sonarframe-{name}-{uuid.uuid4().hex}"


def table(df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
    """``df`` written to a new work table and read back: cuts lineage, survives lost executors."""
    path = work_path(df.sparkSession, name)
    df.write.parquet(path, compression=compression)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back.work_path = path
    return back


def drop(df: DataFrame) -> None:
    """Delete the work table behind ``df``; nothing may read it afterwards."""
    path = getattr(df, "work_path", None)
    if path:
        jvm = df.sparkSession.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def named(name: str) -> Column:
    """A column by its exact name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def row_key(docs: DataFrame) -> DataFrame:
    """``id_text`` with a column ``row`` that tells texts apart that share an id."""
    return docs.withColumn("row", F.xxhash64("doc_id", "text"))


def id_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only identifier and text, as doc_id and text: other columns can't clash with an operator's own."""
    return docs.select(named(id_col).cast("long").alias("doc_id"), named(text_col).cast("string").alias("text"))


def held_out(doc_id: Column, folds: int = 5) -> Column:
    """True where crc32 of the identifier's decimal text is 0 modulo ``folds`` (a null id is held out)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % F.lit(folds) == 0, F.lit(True))


def fresh(df: DataFrame, name: str) -> str:
    """``name``, made longer until no column of ``df`` has it (in whatever case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def without(docs: DataFrame, gone: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Rows of ``docs`` whose id isn't in ``gone`` (one long column, distinct); rows with a null id stay.

    Up to MOST_IDS identifiers are broadcast; more are joined, with ``docs`` shuffled.
    """
    own = fresh(docs, "gone")
    gone = table(gone.toDF(own), "gone")
    few = gone.count() <= MOST_IDS
    return docs.join(F.broadcast(gone) if few else gone, named(id_col).cast("long") == F.col(own), "left_anti")
