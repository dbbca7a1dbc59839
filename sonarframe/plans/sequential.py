"""Names whose outcome depends on the order: by families of names, and by chunks where a name is plain."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sonarframe.operators.chunks import CHUNK, running_sum
from sonarframe.work import table


def claim(names: list[str]) -> list[str]:
    """Each name as it is the first time, then with 2, 3, ... before its extension, whatever the case; claimed names count too."""
    taken: set[str] = set()
    tried: dict[tuple[str, str], int] = {}  # numbers up to here are taken
    out = []
    for name in names:
        stem, dot, ext = name.rpartition(".") if "." in name[1:] else (name, "", "")
        key = stem.lower(), ext.lower()
        n, now = tried.get(key, 1), name
        while now.lower() in taken:
            n += 1
            now = f"{stem} {n}{dot}{ext}"
        tried[key] = n
        taken.add(now.lower())
        out.append(now)
    return out


def family(name) -> Column:
    """What all names have in common that a name may be turned into: without numbers before the extension, in lower case."""
    stem, ext = F.regexp_extract(name, r"(?s)^(.+?)(\.[^.]*)?$", 1), F.regexp_extract(name, r"(?s)^(.+?)(\.[^.]*)?$", 2)
    return F.lower(F.concat(F.regexp_replace(stem, r"( [0-9]+)+$", ""), ext))


def claim_names(rows: DataFrame, directory: str, name: str, order: str, chunk: int = CHUNK) -> DataFrame:
    """``rows`` (order, directory, name) with ``unique_name``; ``order`` tells a directory's rows apart.

    Only names of one family can meet.  Where a family has a single name, whatever the case, a row's number is
    the count of rows before it, by chunks; where it has several (``a`` and ``a 2``), the family is claimed in one task.
    A null name stays null.
    """
    used = table(rows.select(directory, name, order).withColumn("__family", family(F.col(name))).withColumn("__low", F.lower(F.col(name))), "names")
    kinds = used.groupBy(directory, "__family").agg((F.min("__low") == F.max("__low")).alias("__plain"))
    kinds = kinds.select(F.col(directory).alias("__d"), F.col("__family").alias("__f"), F.coalesce("__plain", F.lit(True)).alias("__plain"))
    used = used.join(kinds, F.col(directory).eqNullSafe(F.col("__d")) & F.col("__family").eqNullSafe(F.col("__f"))).drop("__d", "__f", "__low")

    counted = running_sum(used.where("__plain"), [directory, "__family"], [order], F.lit(1).cast("long"), "__n", chunk)
    number = F.concat(F.lit(" "), (F.col("__n") + 1).cast("string"))
    stem, ext = F.regexp_extract(name, r"(?s)^(.+?)(\.[^.]*)?$", 1), F.regexp_extract(name, r"(?s)^(.+?)(\.[^.]*)?$", 2)
    plain = counted.withColumn("unique_name", F.when((F.col("__n") == 0) | F.col(name).isNull(), F.col(name)).otherwise(F.concat(stem, number, ext)))

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(order, kind="stable")
        return frame.assign(unique_name=claim(frame[name].tolist()))

    plain = plain.select(directory, name, order, "unique_name")
    several = used.where("not __plain")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in plain.schema)
    return plain.unionByName(several.select(directory, name, order, "__family").groupBy(directory, "__family").applyInPandas(lambda frame: run(frame).drop(columns="__family"), schema))
