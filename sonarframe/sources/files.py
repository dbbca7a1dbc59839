"""Collections of files: scanning, filtering, grouping, writing."""

from __future__ import annotations

import io
import uuid
import zipfile
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sonarframe.functions import udf
from sonarframe.functions.columns import col
from sonarframe.work import table

EXTENSIONS = (".wav", ".m4a", ".aif", ".aiff", ".flac", ".mp3")
#: Folders that the engine itself writes, so that outputs aren't read as inputs.
EXCLUDED = ("wav", "chops", "one shots", "chops clean", "one shots clean")


def excluded(path, names: tuple[str, ...] = EXCLUDED) -> Column:
    """Whether a directory of the path is one of the names, whatever the case."""
    parts = F.split(col(path), "/")
    return F.exists(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0))), lambda p: F.lower(p).isin(*names))


def audio(path) -> Column:
    return F.lower(F.regexp_extract(col(path), r"(\.[^./]*)$", 1)).isin(*EXTENSIONS)


def scan(spark: SparkSession, root: str, content: bool = False) -> DataFrame:
    """path, relative_dir, name, ext, length (and content) of audio files under ``root``, without the engine's own outputs.

    Without content Spark only lists files; paths are filtered before anything is read.
    """
    base = root.rstrip("/") + "/"
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    relative = F.substring_index(F.col("path"), base, -1)
    rows = rows.withColumn("relative", relative).where(audio("relative") & ~excluded("relative"))
    rows = rows.withColumn("name", F.substring_index("relative", "/", -1)).withColumn("relative_dir", F.regexp_replace("relative", r"/?[^/]*$", "")).withColumn("ext", F.lower(F.regexp_extract("name", r"(\.[^.]*)$", 1)))
    return rows.select("path", "relative_dir", "name", "ext", "length", *(["content"] if content else []))


def groups(files: DataFrame, path: str = "path"):
    """Files by their first directory."""
    return files.withColumn("group", F.substring_index(path, "/", 1)).groupBy("group")


def source_folders(files: DataFrame, path: str = "path") -> DataFrame:
    """First directories that hold audio somewhere below them."""
    return files.where(audio(path) & F.contains(F.col(path), F.lit("/")) & ~excluded(path)).select(F.substring_index(path, "/", 1).alias("folder")).distinct()


def has_audio(files: DataFrame, path: str = "path") -> bool:
    return bool(files.where(audio(path)).take(1))


def single_group(files: DataFrame, name: str, path: str = "path") -> DataFrame:
    return files.where(audio(path)).withColumn("group", F.lit(name))


def dropped_groups(files: DataFrame, path: str = "path", split: bool = False) -> DataFrame:
    """One row for each dropped folder, or for each of its subfolders, with its files sorted."""
    parts = F.split(F.col(path), "/")
    key = F.when(F.lit(split) & (F.size(parts) > 2), F.concat_ws("/", F.slice(parts, 1, 2))).otherwise(F.get(parts, F.lit(0)))
    return files.where(audio(path)).groupBy(key.alias("group")).agg(F.array_sort(F.collect_list(path)).alias("files"))


def zip_folder(names: Iterable[str], blobs: Iterable[bytes]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED, compresslevel=6) as z:
        for name, blob in zip(names, blobs):
            z.writestr(name, blob)
    return out.getvalue()


def zipped(outputs: DataFrame) -> DataFrame:
    """(folder, archive) of outputs (folder, name, content): one archive a folder."""

    def run(key, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("name")
        return pd.DataFrame({"folder": [key[0]], "archive": [zip_folder(rows["name"], rows["content"])]})

    return outputs.groupBy("folder").applyInPandas(run, "folder string, archive binary")


def to_write(outputs: DataFrame, dry_run: bool = False) -> DataFrame:
    """Outputs that are written: none in a dry run, and none of files that are left out."""
    return outputs.where(F.lit(not dry_run) & F.coalesce(F.col("included"), F.lit(True)) & F.coalesce(F.col("export_included"), F.lit(True)))


def write(outputs: DataFrame, root: str) -> DataFrame:
    """Write (directory, name, content) rows as files below ``root``, at once; (path, bytes) of each, as a table that can be read again.

    ``root`` is a path or URI of any file system that Arrow knows; on a cluster, one that all executors share.
    A file is written beside its place and then moved there, so a task that's run again
    or lost leaves no half file; equal paths are the caller's to avoid (``claim_names``).
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(root) if "://" in root else (fs.LocalFileSystem(), root)
        for frame in frames:
            done = []
            for directory, name, content in zip(frame["directory"], frame["name"], frame["content"]):
                folder = "/".join(x for x in (base.rstrip("/"), directory.strip("/")) if x)
                store.create_dir(folder, recursive=True)
                part = f"{folder}/.{name}.{uuid.uuid4().hex}"
                with store.open_output_stream(part) as out:
                    out.write(content)
                store.move(part, f"{folder}/{name}")
                done.append((f"{folder}/{name}", len(content)))
            yield pd.DataFrame(done, columns=["path", "bytes"])

    udf.bounded(outputs.sparkSession)
    return table(outputs.select("directory", "name", "content").mapInPandas(run, "path string, bytes long"), "written")


def remove(gone: DataFrame, root: str) -> DataFrame:
    """Delete the files (directory, name) below ``root`` that are there, at once; (path, removed) of each, as a table."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(root) if "://" in root else (fs.LocalFileSystem(), root)
        for frame in frames:
            paths = ["/".join(x for x in (base.rstrip("/"), d.strip("/"), n) if x) for d, n in zip(frame["directory"], frame["name"])]
            there = [i.type == fs.FileType.File for i in store.get_file_info(paths)]
            for path, found in zip(paths, there):
                if found:
                    store.delete_file(path)
            yield pd.DataFrame({"path": paths, "removed": there})

    return table(gone.select("directory", "name").mapInPandas(run, "path string, removed boolean"), "removed")


def stale(existing: DataFrame, targets: DataFrame) -> DataFrame:
    """Numbered outputs (``12.wav``) of directories that are about to be written again; other files are left alone."""
    return existing.join(targets.select("directory").distinct(), "directory", "left_semi").where(F.col("name").rlike(r"^\d+\.wav$"))


def stale_variations(existing: DataFrame, targets: DataFrame) -> DataFrame:
    return existing.join(targets.select("directory").distinct(), "directory", "left_semi").where(F.lower("name").endswith(".wav"))
