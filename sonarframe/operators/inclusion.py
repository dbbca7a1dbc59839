"""What takes part: inclusion flags of files, effective settings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sonarframe.functions.columns import col


def included(flag) -> Column:
    """A flag that isn't set counts as set."""
    return F.coalesce(col(flag), F.lit(True))


def normalise(files: DataFrame, *flags: str) -> DataFrame:
    return files.withColumns({f: included(f) for f in flags})


def included_files(files: DataFrame, flag: str = "included") -> DataFrame:
    return files.where(included(flag))


def exportable(files: DataFrame) -> DataFrame:
    return files.where(included("included") & included("export_included"))


def set_all(files: DataFrame, flag: str, value: bool) -> DataFrame:
    return files.withColumn(flag, F.lit(value))


def none_included(files: DataFrame, condition: Column) -> DataFrame:
    """One row: whether no file meets the condition (true for no files)."""
    return files.agg((~F.coalesce(F.bool_or(condition), F.lit(False))).alias("none"))


def active_key(keys, current) -> Column:
    """The current key if it's among ``keys``, else the first, else null."""
    return F.when(F.array_contains(col(keys), col(current)), col(current)).otherwise(F.get(col(keys), F.lit(0)))


def lofi_active(task, stage, drive, crunch) -> Column:
    return F.when(col(task) == "chop", F.coalesce(col(stage), F.lit(False))).otherwise(F.coalesce(col(stage), F.lit(False)) | F.coalesce(col(drive), F.lit(False)) | F.coalesce(col(crunch), F.lit(False)))


def lofi_settings(task, stage, drive, crunch) -> Column:
    """struct(stage, drive, crunch): cutting uses the stage only."""
    chop = col(task) == "chop"
    return F.struct(col(stage).alias("stage"), F.when(chop, False).otherwise(col(drive)).alias("drive"), F.when(chop, False).otherwise(col(crunch)).alias("crunch"))


def clean_secondary(active, also_clean) -> Column:
    return F.coalesce(col(active) & col(also_clean), F.lit(False))


def variation_set(characters: DataFrame, wanted: DataFrame, key: str = "key") -> DataFrame:
    """Characters that are wanted, in their own order."""
    return characters.join(wanted.select(key).distinct(), key, "left_semi")
