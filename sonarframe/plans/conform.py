"""Conform plans: what to do to a loop so that it meets a target, as one struct column.

The plan is pure expressions over a source and a target; rendering it is a kernel's work
and only needed where ``changes_audio``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sonarframe.functions import levels, music, tempo, udf
from sonarframe.functions.columns import col
from sonarframe.kernels import analysis, stretch

#: What each kind of input allows, and the methods with their limits.
ROLES = {"loop": ("fit_tempo", "fit_pitch"), "oneshot": ("fit_pitch",), "texture": ("fit_tempo", "fit_pitch")}
METHODS = {"transient": ("Transient", "transient", True, 8.0), "punch": ("Punch", "punch", True, 8.0), "clean": ("Clean", "clean", True, 8.0), "tight": ("Tight", "tight", True, 8.0), "cyclic": ("Cyclic", "cyclic", True, 8.0), "grain": ("Grain", "grain", True, 8.0), "spectral": ("Spectral", "spectral", True, 8.0), "tape": ("Tape", "tape", False, 8.0)}
DEFAULT_METHOD, DEFAULT_ROLE = "transient", "loop"


def _map(table: dict, value=lambda v: v) -> Column:
    return F.create_map(*(F.lit(x) for k, v in table.items() for x in (k, value(v))))


def method_key(loop_method, session_method) -> Column:
    """A loop's own method unless it inherits, then the session's, then the default; unknown ones are the default."""
    own = F.when(col(loop_method) != "inherit", col(loop_method))
    key = F.coalesce(own, col(session_method), F.lit(DEFAULT_METHOD))
    return F.when(key.isin(*METHODS), key).otherwise(F.lit(DEFAULT_METHOD))


def method(key) -> Column:
    """struct(key, label, preserves_pitch, max_ratio); an unknown key has the label of ``clean``."""
    known = col(key).isin(*METHODS)
    at = lambda i: F.try_element_at(_map(METHODS, lambda v: v[i]), col(key))
    return F.struct(F.when(known, col(key)).otherwise(DEFAULT_METHOD).alias("key"), F.coalesce(at(0), F.lit("Clean")).alias("label"), F.coalesce(at(2), F.lit(True)).alias("preserves_pitch"), F.coalesce(at(3), F.lit(8.0)).alias("max_ratio"))


def method_groups() -> dict[str, list[str]]:
    out: dict[str, list[str]] = {}
    for key, (_, character, _, _) in METHODS.items():
        out.setdefault(stretch.CHARACTERS[character]["group"], []).append(key)
    return out


def supports(role, capability: str) -> Column:
    role = F.when(col(role).isin(*ROLES), col(role)).otherwise(F.lit(DEFAULT_ROLE))
    return role.isin(*(r for r, c in ROLES.items() if capability in c))


def with_tempo(loops: DataFrame, target_bpm: float | None, feel: str = "normal", snap: bool = True, octave: bool = True) -> DataFrame:
    """``loops`` with ``__t``: struct(source_bpm, target_bpm, ratio, applied, reason, auto_octave, snapped, extreme, clamped, warnings).

    Steps are columns of their own: inlined, each would repeat the trees of the ones before it.
    """
    wanted = tempo.positive_or_null(F.lit(target_bpm).cast("double"))
    loops = loops.withColumn("__bpm", tempo.positive_or_null("bpm")).withColumn("__wanted", wanted).withColumn("__target", tempo.feel_target("__wanted", F.lit(feel)))
    manual = F.coalesce(F.col("bpm_manual"), F.lit(False))
    loops = loops.withColumn("__fixed", F.when(~manual, tempo.better_octave("__bpm", "__wanted")) if octave else F.lit(None).cast("double"))
    loops = loops.withColumn("__read", F.coalesce("__fixed", "__bpm"))
    loops = loops.withColumn("__snap", tempo.loop_snap("duration", "__read").bpm if snap else F.lit(None).cast("double"))
    loops = loops.withColumn("__source", F.coalesce("__snap", "__read")).withColumn("__raw", tempo.ratio_for("__source", "__target")).withColumn("__hint", tempo.better_octave("__source", "__target"))
    loops = loops.withColumn("__ratio", F.greatest(F.lit(0.05), F.least(F.col("__m.max_ratio"), F.col("__raw"))))
    ratio, raw = F.col("__ratio"), F.col("__raw")
    reason = (
        F.when(~supports("role", "fit_tempo"), "not applicable to this input type").when(~F.coalesce(F.col("tempo_fit"), F.lit(False)), "tempo fitting off")
        .when(F.col("__source").isNull(), "no source BPM").when(F.col("__target").isNull(), "no target BPM").when(F.abs(ratio - 1) <= 1e-6, "already at the target tempo")
    )
    loops = loops.withColumn("__why", reason)
    works = F.col("__why").isNull()
    extreme, clamped = works & ((raw < 0.5) | (raw > 2)), works & (F.abs(ratio - raw) > 1e-6)
    warnings = F.filter(F.array(F.when(works & F.col("__hint").isNotNull(), "octave-suggestion").when(extreme, "extreme-stretch"), F.when(clamped, "ratio-clamped")), lambda w: w.isNotNull())
    whole = F.struct(F.col("__source").alias("source_bpm"), F.col("__target").alias("target_bpm"), F.when(works, ratio).otherwise(1.0).alias("ratio"), works.alias("applied"), F.col("__why").alias("reason"), F.col("__fixed").isNotNull().alias("auto_octave"), F.col("__snap").isNotNull().alias("snapped"), extreme.alias("extreme"), clamped.alias("clamped"), warnings.alias("warnings"))
    return loops.withColumn("__t", whole).drop("__bpm", "__wanted", "__target", "__fixed", "__read", "__snap", "__source", "__raw", "__hint", "__ratio", "__why")


def with_pitch(loops: DataFrame, target_key: str | None, target_mode: str | None, pitch_enabled: bool = True, strategy: str = "relative") -> DataFrame:
    """``loops`` (with ``__m`` and ``__t``) with ``__p``: struct(semitones, drift, resulting_shift, applied, reason, relative_used, mode_mismatch, result_key, warnings)."""
    loops = loops.withColumn("__drift", F.when(~F.col("__m.preserves_pitch") & F.col("__t.applied"), levels.ratio_to_semitones(1 / F.col("__t.ratio"))).otherwise(0.0))
    key = F.lit(target_key if pitch_enabled else None).cast("string")
    loops = loops.withColumn("__x", music.transposition("key", "mode", key, F.lit(target_mode).cast("string"), strategy))
    off = F.when(~supports("role", "fit_pitch"), "not applicable to this input type").when(~F.coalesce(F.col("pitch_fit"), F.lit(False)), "pitch fitting off").when(~F.col("__x.ok"), F.col("__x.reason"))
    loops = loops.withColumn("__off", off).withColumn("__stage", music.clamp_semitones(F.col("__x.semitones") - F.col("__drift")))
    works, wanted, stage, drift, mismatch = F.col("__off").isNull(), F.col("__x.semitones"), F.col("__stage"), F.col("__drift"), F.col("__x.mode_mismatch")
    still = works & (F.abs(wanted) <= 1e-6) & (F.abs(stage) <= 1e-6)
    reason = F.coalesce("__off", F.when(still & mismatch, "same root, other mode").when(still, "already in the target key"))
    warnings = F.filter(F.array(F.when(~works & (F.abs(drift) > 0.01), "method-pitch-drift"), F.when(works & mismatch, "mode-mismatch"), F.when(works & (F.abs(wanted - drift) > music.PITCH_LIMIT), "pitch-clamped")), lambda w: w.isNotNull())
    moved = F.when(works, stage).otherwise(0.0)
    whole = F.struct(moved.alias("semitones"), drift.alias("drift"), (moved + drift).alias("resulting_shift"), (works & (F.abs(stage) > 1e-6)).alias("applied"), reason.alias("reason"), (works & F.col("__x.relative_used")).alias("relative_used"), (works & mismatch).alias("mode_mismatch"), F.when(works, F.col("__x.result_key")).alias("result_key"), warnings.alias("warnings"))
    return loops.withColumn("__p", whole).drop("__drift", "__x", "__off", "__stage")


def plan(loops: DataFrame, target_bpm: float | None = 120.0, target_key: str | None = "C", target_mode: str | None = "minor", pitch_enabled: bool = True, session_method: str = DEFAULT_METHOD, strategy: str = "relative", feel: str = "normal", align: bool = True) -> DataFrame:
    """``loops`` (bpm, bpm_manual, duration, key, mode, role, tempo_fit, pitch_fit, method) with a ``plan`` struct."""
    loops = loops.withColumn("__m", method(method_key("method", F.lit(session_method))))
    loops = with_pitch(with_tempo(loops, target_bpm, feel), target_key, target_mode, pitch_enabled, strategy)
    alignment = F.struct((F.lit(align) & supports("role", "fit_tempo")).alias("enabled"), F.when(F.col("__t.applied"), F.col("__t.target_bpm")).otherwise(F.col("__t.source_bpm")).alias("output_bpm"))
    whole = F.struct(F.col("__m").alias("method"), F.col("__t").alias("tempo"), F.col("__p").alias("pitch"), alignment.alias("align"), (F.col("__t.applied") | F.col("__p.applied")).alias("changes_audio"), F.concat("__t.warnings", "__p.warnings").alias("warnings"))
    return loops.withColumn("plan", whole).drop("__m", "__t", "__p")


def predicted_duration(seconds, ratio) -> Column:
    return col(seconds) * col(ratio)


def target_readiness(bpm, key, pitch_enabled) -> Column:
    tempo_ready, pitch_ready = tempo.positive_or_null(bpm).isNotNull(), col(pitch_enabled) & music.is_note(key)
    return F.struct(tempo_ready.alias("tempo"), pitch_ready.alias("pitch"), (tempo_ready | pitch_ready).alias("usable"))


def target_from_reference(bpm, key, scale, context_bpm, context_key, context_mode) -> Column:
    """A target from what was detected in a reference, and from the context where nothing was."""
    note = music.is_note(key)
    return F.struct(F.coalesce(F.floor(tempo.positive_or_null(bpm) + 0.5).cast("double"), col(context_bpm)).alias("bpm"), F.when(note, col(key)).otherwise(col(context_key)).alias("key"), F.when(note, F.coalesce(music.mode(scale), col(context_mode))).otherwise(col(context_mode)).alias("mode"), note.alias("pitch_enabled"))


def render(channels: list[np.ndarray], rate: float, ratio: float = 1.0, semitones: float = 0.0, character: str = "transient", align_bpm: float | None = None, output_bpm: float | None = None, seed: int = 1) -> list[np.ndarray]:
    """A plan carried out: aligned, stretched and shifted in one stretch where its ratio is reachable, aligned again."""
    out = [np.asarray(c, dtype=np.float32) for c in channels]
    n = len(out[0]) if out else 0
    if align_bpm:
        out = analysis.align(out, rate, align_bpm)[0]
    factor = 2 ** (semitones / 12)
    if abs(semitones) > 1e-6 and stretch.LEAST_RATIO <= ratio * factor <= 8:
        length = max(1, int(n * ratio + 0.5))
        made = [stretch.resample(c, 1 / factor)[:length] for c in stretch.stretch(out, rate, ratio * factor, character, seed=seed)]
        out = [np.concatenate([c, np.zeros(length - len(c), dtype=np.float32)]) for c in made]
    else:
        out = stretch.pitch_shift(stretch.stretch(out, rate, ratio, character, seed=seed), rate, semitones, character, seed=seed)
    return analysis.align(out, rate, output_bpm)[0] if output_bpm and align_bpm else out


def rendered(planned: DataFrame) -> DataFrame:
    """(file, channels) of planned rows (file, sample_rate, channels, plan) that change; one whole signal a row."""
    rows = planned.where("plan.changes_audio or plan.align.enabled").select("file", "sample_rate", "channels", F.col("plan.tempo.ratio").alias("ratio"), F.col("plan.pitch.semitones").alias("semitones"), F.col("plan.method.key").alias("character"), F.when(F.col("plan.align.enabled"), F.col("plan.tempo.source_bpm")).alias("align_bpm"), F.col("plan.align.output_bpm").alias("output_bpm"))

    udf.bounded(planned.sparkSession)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for i, r in enumerate(frame.itertuples()):
                made = render([np.asarray(x) for x in r.channels], r.sample_rate, r.ratio, r.semitones, METHODS[r.character][1], r.align_bpm if r.align_bpm == r.align_bpm else None, r.output_bpm)
                yield pd.DataFrame({"file": frame["file"].iloc[i : i + 1].to_list(), "channels": [[np.asarray(c, dtype=np.float32) for c in made]]})

    return rows.mapInPandas(run, f"file {planned.schema['file'].dataType.simpleString()}, channels array<array<float>>")


def format_target(bpm, key, mode, pitch_enabled) -> Column:
    """``126 BPM / E minor``: the parts of a target that are ready, or that there is none yet."""
    ready = target_readiness(bpm, key, pitch_enabled)
    shown = F.concat_ws(" / ", F.when(ready["tempo"], F.concat(F.floor(col(bpm) + 0.5).cast("long").cast("string"), F.lit(" BPM"))), F.when(ready["pitch"], music.format_key(key, mode)))
    return F.when(shown == "", F.lit("no target yet")).otherwise(shown)
