"""Notes, modes, transposition and scale degrees."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sonarframe.functions.columns import col
from sonarframe.functions.numbers import clamp

#: Note names by semitone, other spellings, and scale steps.
NOTES = ("C", "C#", "D", "D#", "E", "F", "F#", "G", "G#", "A", "A#", "B")
ALIASES = {"DB": "C#", "EB": "D#", "GB": "F#", "AB": "G#", "BB": "A#", "CB": "B", "FB": "E", "E#": "F", "B#": "C"}
SCALES = {"major": (0, 2, 4, 5, 7, 9, 11), "minor": (0, 2, 3, 5, 7, 8, 10)}
MINOR_NAMES = ("minor", "min", "m", "aeolian")
PITCH_LIMIT = 24


def note_index(name) -> Column:
    """0..11, or null for what isn't a note."""
    clean = F.upper(F.replace(F.replace(F.trim(col(name)), F.lit("♯"), F.lit("#")), F.lit("♭"), F.lit("b")))
    table = {n: i for i, n in enumerate(NOTES)} | {a: NOTES.index(n) for a, n in ALIASES.items()}
    return F.try_element_at(F.create_map(*(F.lit(x) for kv in table.items() for x in kv)), clean)


def note_name(index) -> Column:
    return F.element_at(F.array(*map(F.lit, NOTES)), (F.pmod(col(index), F.lit(12)) + 1).cast("int"))


def is_note(name) -> Column:
    return note_index(name).isNotNull()


def mode(name) -> Column:
    """``minor`` for its names, ``major`` for any other text, null for none."""
    m = F.lower(F.trim(col(name)))
    return F.when(m.isNull() | (m == ""), F.lit(None)).when(m.isin(*MINOR_NAMES), F.lit("minor")).otherwise(F.lit("major"))


def nearest_semitones(from_index, to_index) -> Column:
    """-5..6: a tritone goes up."""
    raw = F.pmod(col(to_index) - col(from_index), F.lit(12))
    return F.when(raw > 6, raw - 12).otherwise(raw)


def relative_root(index, mode_name) -> Column:
    """Root of the relative major of a minor key, or the relative minor of a major one."""
    return F.pmod(col(index) + F.when(col(mode_name) == "minor", 3).otherwise(-3), F.lit(12))


def transposition(source_key, source_mode, target_key, target_mode, strategy: str = "relative") -> Column:
    """struct(semitones, ok, reason, mode_mismatch, relative_used, result_key, result_mode).

    ``nearest-root`` moves root onto root and flags modes that differ; ``relative``
    moves onto the target's relative key where modes differ, so the notes agree.
    """
    s, t, sm, tm = note_index(source_key), note_index(target_key), mode(source_mode), mode(target_mode)
    differ = F.coalesce(sm != tm, F.lit(False))
    relative = strategy != "nearest-root"
    root = F.when(differ & F.lit(relative), relative_root(t, tm)).otherwise(t)
    ok = s.isNotNull() & t.isNotNull()
    return F.struct(
        F.when(ok, nearest_semitones(s, root)).otherwise(0).cast("int").alias("semitones"),
        ok.alias("ok"),
        F.when(s.isNull(), F.lit("no source key")).when(t.isNull(), F.lit("no target key")).alias("reason"),
        (ok & differ & F.lit(not relative)).alias("mode_mismatch"),
        (ok & differ & F.lit(relative)).alias("relative_used"),
        F.when(ok, note_name(root)).alias("result_key"),
        F.when(ok, sm).alias("result_mode"),
    )


def format_key(key, mode_name) -> Column:
    name = F.coalesce(note_name(note_index(key)), col(key))
    return F.when(col(key).isNull() | (col(key) == ""), F.lit("")).otherwise(F.concat_ws(" ", name, mode(mode_name)))


def format_semitones(st) -> Column:
    st = col(st)
    n = F.when(st == F.floor(st), st.cast("long").cast("string")).otherwise(F.format_string("%.2f", st.cast("double")))
    return F.when(st == 0, F.lit("no change")).otherwise(F.concat(F.when(st > 0, "+").otherwise(""), n, F.lit(" st")))


def clamp_semitones(st) -> Column:
    return clamp(st, -PITCH_LIMIT, PITCH_LIMIT)


def degree_semitones(mode_name, degree) -> Column:
    """Semitones of a scale degree from 0, below and above the octave too; minor where the mode is unknown."""
    d = col(degree)
    steps = F.when(mode(mode_name) == "major", F.array(*map(F.lit, SCALES["major"]))).otherwise(F.array(*map(F.lit, SCALES["minor"])))
    return F.element_at(steps, (F.pmod(d, F.lit(7)) + 1).cast("int")) + 12 * F.floor(d / 7).cast("int")


def degree_offsets(mode_name, most: int = 7) -> Column:
    """array<struct(degree, semitones)> for -most..most without 0."""
    degrees = F.filter(F.sequence(F.lit(-most), F.lit(most)), lambda d: d != 0)
    return F.transform(degrees, lambda d: F.struct(d.alias("degree"), degree_semitones(mode_name, d).alias("semitones")))


def resolve_key(root, mode_name) -> Column:
    """struct(root, mode, known): a note's usual name or null, the mode (minor if there is none), whether the root is a note."""
    index = note_index(root)
    return F.struct(F.when(index.isNotNull(), note_name(index)).alias("root"), F.coalesce(mode(mode_name), F.lit("minor")).alias("mode"), index.isNotNull().alias("known"))
