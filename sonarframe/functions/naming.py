"""Names of outputs: patterns, tags, safe stems and collisions."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sonarframe.functions.columns import col
from sonarframe.functions.numbers import half_up

TOKENS = ("name", "folder", "tag", "key", "tempo", "number")
_TOKEN = re.compile(r"\{(" + "|".join(TOKENS) + r")\}", re.I)


def truncate_stem(s, limit: int) -> Column:
    s = col(s)
    return F.when(F.length(s) <= limit, s).otherwise(F.regexp_replace(F.substring(s, 1, limit), r"[\s_-]+$", "")) if limit else s


def sanitize_for_path(s, limit: int = 0) -> Column:
    """Separators and characters that file systems refuse become ``-``, white space single spaces."""
    return truncate_stem(F.trim(F.regexp_replace(F.regexp_replace(col(s), r'[/\\:*?"<>|,\[\]]', "-"), r"\s+", " ")), limit)


def join_parts(*parts, sep: str = " ") -> Column:
    """Parts that are neither null nor empty (concat_ws alone keeps empty ones)."""
    return F.array_join(F.filter(F.array(*(col(p).cast("string") for p in parts)), lambda p: p.isNotNull() & (p != "")), sep)


def key_tempo_tag(key, scale, bpm, sep: str = " ") -> Column:
    """Like ``C#m 120bpm``; what is missing, or a tempo of 0, is left out."""
    key, bpm = col(key), col(bpm)
    k = F.when((key.isNotNull()) & (key != ""), F.when(col(scale) == "minor", F.concat(key, F.lit("m"))).otherwise(key))
    t = F.when(bpm.isNotNull() & (bpm != 0), F.concat(half_up(bpm).cast("string"), F.lit("bpm")))
    return join_parts(k, t, sep=sep)


def segments(pattern: str | None) -> list[dict[str, str]]:
    """A naming pattern as text and token segments; token names in any case."""
    out, last, s = [], 0, pattern or ""
    for m in _TOKEN.finditer(s):
        if m.start() > last:
            out.append({"type": "text", "value": s[last : m.start()]})
        out.append({"type": "token", "key": m[1].lower()})
        last = m.end()
    if last < len(s):
        out.append({"type": "text", "value": s[last:]})
    return out


def pattern_of(parts: list[dict[str, str]]) -> str:
    return "".join(p["value"] if p["type"] == "text" else "{" + p["key"] + "}" for p in parts)


def is_token(key) -> Column:
    return F.lower(col(key)).isin(*TOKENS)


def resolve_pattern(pattern: str, values: dict[str, Column]) -> Column:
    """Tokens replaced by their values, missing ones by nothing, in one pass: a value that looks like a token stays."""
    parts = [F.lit(p["value"]) if p["type"] == "text" else F.coalesce(values[p["key"]].cast("string"), F.lit("")) if p["key"] in values else F.lit("") for p in segments(pattern)]
    return F.concat(*parts) if parts else F.lit("")


def resolve_folder(pattern: str | None, values: dict[str, Column]) -> Column:
    out = F.trim(F.regexp_replace(resolve_pattern((pattern or "").strip() or "{name}", values), r"\s+", " "))
    return F.when(out != "", out).otherwise(F.coalesce(values.get("name", F.lit("")), F.lit("")))


def stem_of(name) -> Column:
    """Without the last extension; a leading dot doesn't begin one."""
    return F.regexp_replace(col(name), r"(?s)^(.+)\.[^.]*$", "$1")


def padded(n, width: int = 2) -> Column:
    """Zeros in front up to ``width``; longer numbers stay whole (lpad would cut them)."""
    s = half_up(n).cast("string")
    return F.when(F.length(s) >= width, s).otherwise(F.lpad(s, width, "0"))


def chop_name(stem, tag, index, pattern: str = "{name} {tag} {number}", **values: Column) -> Column:
    """A chop's file name; ``{number}`` is added where the pattern lacks it."""
    if "{number}" not in pattern.lower():
        pattern += " {number}"
    return F.concat(sanitize_for_path(resolve_pattern(pattern, {"name": col(stem), "tag": col(tag), "number": padded(index)} | values), 180), F.lit(".wav"))


def tagged_stem(stem, key, scale, bpm, folder=None, pattern: str = "{name}") -> Column:
    values = {"name": col(stem), "folder": col(folder) if folder is not None else F.lit("")}
    return sanitize_for_path(join_parts(resolve_folder(pattern, values), key_tempo_tag(key, scale, bpm)), 180)


def source_folder_name(relative_dir, folder, loose) -> Column:
    """Last part of the directory, else the folder's name; empty for loose files."""
    last = F.regexp_extract(F.coalesce(col(relative_dir), F.lit("")), r"([^/]+)/*$", 1)
    return F.when(col(loose), F.lit("")).otherwise(F.when(last != "", last).otherwise(col(folder)))


def source_path(root, relative_dir, name) -> Column:
    parts = F.filter(F.concat(F.array(col(root)), F.split(F.coalesce(col(relative_dir), F.lit("")), "/"), F.array(col(name))), lambda p: p.isNotNull() & (p != ""))
    return F.array_join(parts, " / ")


def conformed_name(name, key, key_mode, bpm, tempo_fit, pitch_fit, marker: str = "play nice") -> Column:
    stem = truncate_stem(stem_of(name), 120)
    tag = key_tempo_tag(F.when(col(pitch_fit), col(key)), key_mode, F.when(col(tempo_fit), col(bpm)))
    safe = sanitize_for_path(join_parts(stem, F.lit(marker), tag), 180)
    return F.concat(F.when(safe != "", safe).otherwise(F.lit(marker)), F.lit(".wav"))


def batch_folder(key, key_mode, bpm, pitch_enabled, marker: str = "play nice") -> Column:
    return sanitize_for_path(join_parts(F.lit(marker), key_tempo_tag(F.when(col(pitch_enabled), col(key)), key_mode, bpm)), 180)


def variation_name(stem, index, seed) -> Column:
    return F.concat(sanitize_for_path(stem_of(stem), 120), F.lit("_FLIP_"), padded(F.greatest(F.lit(1), half_up(index))), F.lit("_seed"), (col(seed).cast("long").bitwiseAND(F.lit(0xFFFFFFFF))).cast("string"), F.lit(".wav"))


def character_name(stem, label) -> Column:
    return F.concat(col(stem), F.lit(" "), col(label), F.lit(".wav"))


#: How a fragment's kind is written in a file name.
SOURCE_SLUGS = {"snare": "snare", "hit": "hit", "1/16": "1-16", "1/8": "1-8", "1/4": "1-4", "manual": "sel"}


def fx_name(name, kind, ratio, reverse, pitch) -> Column:
    slug = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in SOURCE_SLUGS.items() for x in kv)), col(kind)), F.lit("fx"))
    turned = F.when(col(reverse) == "pre", "rev").when(col(reverse) == "post", "revpost")
    moved = F.when(col(pitch) < 0, F.concat(F.lit("dn"), (-col(pitch)).cast("string"))).when(col(pitch) > 0, F.concat(F.lit("up"), col(pitch).cast("string")))
    return F.concat(join_parts(sanitize_for_path(stem_of(name), 120), F.lit("stretch"), slug, half_up(col(ratio) * 100).cast("string"), turned, moved, sep="_"), F.lit(".wav"))


def fx_folder(name) -> Column:
    return F.concat(sanitize_for_path(stem_of(name), 120), F.lit("_STRETCH_FX"))


def flip_folder(name) -> Column:
    return F.concat(sanitize_for_path(stem_of(name), 120), F.lit("_FLIP"))


def bpm_text(bpm, manual, available) -> Column:
    bpm = col(bpm)
    known = F.concat(half_up(bpm).cast("string"), F.lit(" BPM"), F.when(col(manual), F.lit(" (manual)")).otherwise(F.lit("")))
    return F.when(bpm.isNotNull() & (bpm != 0), known).otherwise(F.when(col(available), F.lit("unclear")).otherwise(F.lit("unavailable")))


def key_text(key, scale, enabled, available) -> Column:
    shown = F.concat_ws(" ", col(key), col(scale))
    return F.when(~col(enabled), F.lit("off")).when(col(key).isNotNull(), shown).otherwise(F.when(col(available), F.lit("unknown")).otherwise(F.lit("unavailable")))


def numbered_names(rows: DataFrame, directory: str, name: str, order: str, out: str = "unique_name") -> DataFrame:
    """The second ``Kick`` of a directory becomes ``Kick 2`` and so on, whatever the case.

    A window over (directory, lower-case name); a generated name may in turn meet a
    name that is there, which ``plans.sequential.claim_names`` resolves exactly.
    """
    w = Window.partitionBy(directory, F.lower(name)).orderBy(order)
    n = F.row_number().over(w)
    return rows.withColumn(out, F.when(n == 1, F.col(name)).otherwise(F.concat(F.col(name), F.lit(" "), n.cast("string"))))
