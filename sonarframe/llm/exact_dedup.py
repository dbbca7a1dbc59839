"""Exact duplicates through a stream with disk-backed keyed state.

Digests of whole texts arrive as a stream; a streaming aggregation without
watermark, so without expiry, keeps for each digest the number of rows and the
identifier and content locator (file, row) of the row that stays, in RocksDB
state with its checkpoint in the shared folder.  Full bytes of the rows that hit a
digest with other rows are then compared: the least and the greatest text of a
digest are one.  Should they differ, those digests are resolved by whole texts.

DataFrame operations only.  Map-side aggregation takes a hot text down to one row
a task before the shuffle into state, and again in the byte check, which reads only
texts that a bitmap of the digests with several rows lets through.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sonarframe.llm.shared import fresh, drop, named, shared_dir, table, work_path

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Memory bounded over all stores of an executor; no space allocated ahead for the log files of many small stores; a commit writes one file, its changes.
_ROCKS = "spark.sql.streaming.stateStore.rocksdb."
STREAM_SETTINGS = {PROVIDER: ROCKSDB, f"{_ROCKS}boundedMemoryUsage": "true", f"{_ROCKS}maxMemoryUsageMB": "128", f"{_ROCKS}writeBufferSizeMB": "4", f"{_ROCKS}allowFAllocate": "false", f"{_ROCKS}changelogCheckpointing.enabled": "true"}
#: For checkpoints in a mounted folder, where a rename replaces: Spark's default starts processes (readlink) from the executor for renames there.
LOCAL_SETTINGS = {"spark.sql.streaming.checkpointFileManagerClass": "org.apache.spark.sql.execution.streaming.checkpointing.FileSystemBasedCheckpointFileManager"}


MOST_BITS, _PIECE = 1 << 27, 32768  # bits of the bitmap, and of one of bitmap_construct_agg
#: Rows that are left out by a broadcast of their locators; more are joined.
MOST_DROPPED = 1 << 18


def _sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def _located(docs: DataFrame, id_col: str, text_col: str, digest: Callable[[Column], Column] | None) -> DataFrame:
    """doc_id, text (null as empty), digest, and where the row's content is: file and row number if ``docs`` reads files."""
    text = F.coalesce(named(text_col).cast("string"), F.lit(""))
    columns = [named(id_col).cast("long").alias("doc_id"), text.alias("text"), (digest or _sha256)(text).alias("digest"), _sha256(text).alias("text_sha256")]
    try:
        return docs.select(*columns, F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    except AnalysisException:
        return docs.select(*columns, F.lit("").alias("file"), F.lit(0).cast("long").alias("row"))


def _mounted(spark: SparkSession, path: str) -> bool:
    """Whether ``path`` is in a file system that is mounted, not in a store of its own."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getUri().getScheme() == "file"


def keyed_state(arrivals: DataFrame, checkpoint: str, out: str) -> None:
    """Run the stream of (digest, doc_id, file, row) over all that has arrived; ``checkpoint`` resumes it.

    Each batch writes the state rows that it changed to its own folder, again the
    same after a replay.  Counts and the largest (doc_id, file, row) only grow, so
    the latest state of a digest is the maximum over batches.
    """
    spark = arrivals.sparkSession
    state = arrivals.groupBy("digest").agg(F.count("*").alias("group_size"), F.max(F.struct("doc_id", "file", "row")).alias("keep"))
    settings = STREAM_SETTINGS | (LOCAL_SETTINGS if _mounted(spark, checkpoint) else {})
    before = {k: spark.conf.get(k, None) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        query = (
            state.writeStream.outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True)
            .foreachBatch(lambda rows, batch: rows.write.mode("overwrite").parquet(f"{out}/batch={batch}")).start()
        )
        query.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _hits(located: DataFrame, groups: DataFrame) -> DataFrame:
    """Rows whose digest may be in ``groups`` (a table), by a bitmap of about 16 bits a digest and at most MOST_BITS (16 MB), 4 KB a piece."""
    n, bits = groups.count(), 1 << 16
    while bits < min(16 * n, MOST_BITS):
        bits *= 2
    slot = F.pmod(F.xxhash64("digest"), F.lit(bits))
    pieces = groups.select(slot.alias("slot")).groupBy(F.expr(f"slot div {_PIECE}").alias("p")).agg(F.bitmap_construct_agg(F.col("slot") % _PIECE).alias("bits"))
    rows = located.withColumn("slot", slot).join(F.broadcast(pieces), F.expr(f"slot div {_PIECE}") == F.col("p"))
    return rows.where(F.expr(f"getbit(cast(conv(hex(substring(bits, cast(slot % {_PIECE} div 8 + 1 as int), 1)), 16, 10) as int), cast(slot % 8 as int)) = 1")).drop("slot", "p", "bits")


def duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: Callable[[Column], Column] | None = None, max_files_per_trigger: int | None = None) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 and the locator (file, row), one row per row of ``docs``.

    Of equal texts (null counts as empty) the row with the largest id stays, a null
    id being the smallest.  Rows repeated with one id are told apart by their locator
    where ``docs`` reads files, and only one of them is kept; in a table without files
    they are all kept or all dropped.  An empty table gives no rows.
    """
    spark: SparkSession = docs.sparkSession
    located = _located(docs, id_col, text_col, digest)
    arrivals = table(located.select("doc_id", "digest", "file", "row", *(["text_sha256"] if digest else [])), "arrivals")
    stream = spark.readStream.schema(arrivals.schema)
    if max_files_per_trigger:
        stream = stream.option("maxFilesPerTrigger", max_files_per_trigger)
    base = work_path(spark, "state")
    keyed_state(stream.parquet(arrivals.work_path), f"{base}/checkpoint", f"{base}/out")
    schema = "digest string, group_size long, keep struct<doc_id:long,file:string,row:long>, batch int"
    state = spark.read.schema(schema).parquet(f"{base}/out").groupBy("digest").agg(F.max("group_size").alias("group_size"), F.max("keep").alias("keep"))
    state = table(state, "groups")

    texts = _hits(located, state.where("group_size > 1")).groupBy("digest").agg(F.min("text").alias("least"), F.max("text").alias("most"))
    differ = table(texts.where("least <> most").select("digest"), "differ")

    same = arrivals.join(state.withColumnRenamed("digest", "d"), F.col("digest") == F.col("d")).drop("d")
    if not digest:
        same = same.withColumn("text_sha256", F.col("digest"))
    if differ.take(1):  # a digest that stands for several texts: its rows are grouped by the texts themselves
        clash = located.join(differ, "digest", "left_semi").withColumn("group_key", F.col("text"))
        by_text = clash.groupBy("digest", "group_key").agg(F.count("*").alias("group_size"), F.max(F.struct("doc_id", "file", "row")).alias("keep"))
        solved = clash.join(by_text, ["digest", "group_key"]).select("doc_id", "digest", "file", "row", "group_size", "keep", "text_sha256")
        same = same.join(differ, "digest", "left_anti").unionByName(solved)
    stays = F.struct("doc_id", "file", "row") == F.col("keep")
    return same.select("doc_id", F.col("keep.doc_id").alias("keep_id"), "group_size", stays.alias("kept"), "text_sha256", "file", "row")


def digest(docs: DataFrame) -> DataFrame:
    return duplicates(docs).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of ``docs`` that stay, with all their columns.

    One row of each text stays: the one with the largest id.  ``docs`` should read files (a written table); rows
    repeated with one id in a table without files stay together.
    """
    found = duplicates(docs, id_col, text_col)
    own = fresh(docs, "here")
    try:
        file, row = F.col("_metadata.file_path"), F.col("_metadata.row_index")
        marked, located = docs.select("*", F.struct(named(id_col).cast("long").alias("doc_id"), file.alias("file"), row.alias("row")).alias(own)), True
    except AnalysisException:
        marked, located = docs.select("*", F.struct(named(id_col).cast("long").alias("doc_id"), F.lit("").alias("file"), F.lit(0).cast("long").alias("row")).alias(own)), False
    there = fresh(marked, "there")
    here = F.struct("doc_id", "file", "row").alias(there)
    if located:
        gone = table(found.where("not kept").select(here), "gone")
        if gone.count() <= MOST_DROPPED:
            return marked.join(F.broadcast(gone), F.col(own).eqNullSafe(F.col(there)), "left_anti").drop(own)
    return marked.join(found.where("kept").select(here), F.col(own).eqNullSafe(F.col(there)), "left_semi").drop(own)


ORACLE = """
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(text) AS text_sha256
FROM t WINDOW w AS (PARTITION BY text)
"""
