"""A data source for long PCM recordings: WAV and AIFF in parts, and WAV output that is there whole or not at all.

    spark.dataSource.register(PcmSource)
    spark.read.format("pcm").schema("path string, start long, samples array<array<float>>").load(folder)

Planning lists files and cuts them into byte ranges; nothing is read for it.  A task
walks the chunk headers of its file and reads only the blocks of frames that begin in
its range, so a block has one reader however a file is cut.  Columns that aren't asked
for in the schema aren't read: without ``samples`` only headers are.  Where the session
has ``spark.sql.python.filterPushdown.enabled``, filters on ``path`` leave files out
when planning, and filters on ``start`` leave blocks unread.

Writing takes blocks (path, start, samples) of each file in one task, in order, as ``write``
arranges them.  A task streams to hidden files beside their places; the commit moves
them there, and an abort, a failed or a repeated task leaves nothing.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from sonarframe.sources.codec import Unsupported, extended
from sonarframe.sources.codec import _pcm as decode_pcm
from sonarframe.sources.files import EXCLUDED

SCHEMA = "path string, start long, frames int, sample_rate int, channels int, bits int, total_frames long, samples array<array<float>>, error string"
EXTENSIONS = (".wav", ".aif", ".aiff")
#: Frames of a block, and bytes of a file that a task reads.
BLOCK, RANGE = 1 << 16, 64 << 20
PUSHDOWN = "spark.sql.python.filterPushdown.enabled"
_TARGET = "path string, start long, samples array<array<float>>, total_frames long, cues array<int>"


def store_of(root: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(root) if "://" in root or root.startswith("file:") else (fs.LocalFileSystem(), root)


@dataclass
class Form:
    """Where a file's samples are, and how they're written."""

    rate: int
    channels: int
    bits: int
    big: bool
    floating: bool
    at: int
    size: int

    @property
    def align(self) -> int:
        return self.channels * self.bits // 8

    @property
    def frames(self) -> int:
        return self.size // self.align


def header(file) -> Form:
    """The form of an open file, from its chunk headers; bodies are skipped."""
    size = file.size()
    head = file.read(12)
    big = head[:4] == b"FORM" and head[8:12] in (b"AIFF", b"AIFC")
    if not big and (head[:4] != b"RIFF" or head[8:12] != b"WAVE"):
        raise Unsupported("neither WAVE nor AIFF")
    order, form, place, at = "big" if big else "little", None, None, 12
    while at + 8 <= size and (form is None or place is None):
        file.seek(at)
        name, length = (said := file.read(8))[:4], int.from_bytes(said[4:], order)
        if name in (b"fmt ", b"COMM"):
            form = file.read(min(length, 64))
        elif name == b"data" and not big:
            place = at + 8, min(length, size - at - 8)
        elif name == b"SSND" and big:
            skip = 8 + int.from_bytes(file.read(4), "big")
            place = at + 8 + skip, max(0, min(length, size - at - 8) - skip)
        at += 8 + length + length % 2
    if form is None or place is None or len(form) < (18 if big else 16):
        raise Unsupported("no form or no samples")
    if big:
        channels, _, bits = struct.unpack(">HIH", form[:8])
        kind = form[18:22] if head[8:12] == b"AIFC" else b"NONE"
        if kind not in (b"NONE", b"sowt"):
            raise Unsupported(f"compressed AIFF ({kind.decode('latin-1')})")
        found = Form(int(extended(form[8:18]) + 0.5), channels, bits, kind == b"NONE" or bits == 8, False, *place)
    else:
        code, channels, rate, _, _, bits = struct.unpack("<HHIIHH", form[:16])
        code = struct.unpack("<H", form[24:26])[0] if code == 0xFFFE and len(form) >= 26 else code
        if code not in (1, 3) or code == 3 and bits != 32:
            raise Unsupported(f"format {code} with {bits} bits")
        found = Form(rate, channels, bits, False, code == 3, *place)
    if not found.channels or found.bits not in (8, 16, 24, 32):
        raise Unsupported(f"{found.bits}-bit samples on {found.channels} channels")
    return found


@dataclass
class Range(InputPartition):
    """Bytes ``low`` to ``high`` of a file."""

    path: str
    low: int
    high: int


class PcmReader(DataSourceReader):
    def __init__(self, options: dict[str, str], schema: StructType):
        self.root, self.schema = options["path"], to_arrow_schema(schema)
        self.block, self.range = int(options.get("block", BLOCK)), int(options.get("range", RANGE))
        self.paths, self.low, self.high = None, 0, None  # as far as filters say

    def _listed(self) -> list[fs.FileInfo]:
        store, base = store_of(self.root)
        info = store.get_file_info(base)
        found = [info] if info.type == fs.FileType.File else store.get_file_info(fs.FileSelector(base, recursive=True))
        inside = lambda f: f.path[len(base) :].lower().split("/")[:-1]
        return sorted((f for f in found if f.type == fs.FileType.File and f.path.lower().endswith(EXTENSIONS) and not f.base_name.startswith(".") and not any(p in EXCLUDED for p in inside(f))), key=lambda f: f.path)

    def partitions(self) -> list[Range]:
        found = [f for f in self._listed() if self.paths is None or f.path in self.paths]
        return [Range(f.path, low, min(low + self.range, f.size)) for f in found for low in range(0, max(1, f.size), self.range)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        store, _ = store_of(self.root)
        row = {name: None for name in self.schema.names} | {"path": partition.path}
        try:
            with store.open_input_file(partition.path) as file:
                form = header(file)
                step = self.block * form.align
                first = max(0, -(-(partition.low - form.at) // step)) if partition.low else 0
                low, high = self.low, form.frames if self.high is None else min(form.frames, self.high)
                if not form.frames and not partition.low:
                    yield self._batch(row, form, 0, 0, None)
                for start in range(first * self.block, form.frames, self.block):
                    if form.at + start * form.align >= partition.high or start >= high:
                        break
                    if start < low:
                        continue
                    frames, samples = min(self.block, form.frames - start), None
                    if "samples" in row:
                        file.seek(form.at + start * form.align)
                        samples = decode_pcm(file.read(frames * form.align), form.bits, form.big, form.channels, form.floating)
                    yield self._batch(row, form, start, frames, samples)
        except (ValueError, struct.error, EOFError) as e:
            if not partition.low:
                yield self._rows({name: str(e) if name == "error" else row.get(name) for name in self.schema.names})

    def _batch(self, row: dict, form: Form, start: int, frames: int, samples: np.ndarray | None) -> pa.RecordBatch:
        known = row | {"start": start, "frames": frames, "sample_rate": form.rate, "channels": form.channels, "bits": form.bits, "total_frames": form.frames}
        return self._rows({name: list(samples) if name == "samples" and samples is not None else [] if name == "samples" else known.get(name) for name in self.schema.names})

    def _rows(self, row: dict) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([row[f.name]], f.type) for f in self.schema], schema=self.schema)


class PushingReader(PcmReader):
    """The reader that takes filters on path and start."""

    def pushFilters(self, filters):
        for f in filters:
            on = ".".join(f.attribute) if hasattr(f, "attribute") else ""
            if on == "path" and isinstance(f, (EqualTo, In)):
                named = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.paths = named if self.paths is None else self.paths & named
                continue
            if on == "start" and isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)):
                self.low = max(self.low, f.value + isinstance(f, GreaterThan))
            if on == "start" and isinstance(f, (EqualTo, LessThan, LessThanOrEqual)):
                most = f.value + (not isinstance(f, LessThan))
                self.high = most if self.high is None else min(self.high, most)
            if on != "start" or not isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)):
                yield f


@dataclass
class Written(WriterCommitMessage):
    """(hidden file, place) of each file of a task."""

    files: list[tuple[str, str]]


def wav_header(rate: int, channels: int, bits: int, frames: int, cues: list[int] | None) -> tuple[bytes, bytes]:
    """What stands before and after a WAV file's samples; cue points are clamped to the last frame."""
    align = channels * bits // 8
    size = frames * align
    tail = b"\0" * (size % 2)
    if cues:
        points = [min(max(0, int(c)), max(0, frames - 1)) for c in cues]
        tail += b"cue " + struct.pack("<II", 4 + 24 * len(points), len(points)) + b"".join(struct.pack("<II4sIII", i + 1, p, b"data", 0, 0, p) for i, p in enumerate(points))
    if size + len(tail) + 36 >= 1 << 32:
        raise Unsupported("a WAV file is less than 4 GB")
    return b"RIFF" + struct.pack("<I", 36 + size + len(tail)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, channels, rate, rate * align, align, bits) + b"data" + struct.pack("<I", size), tail


def pcm_bytes(samples: np.ndarray, bits: int) -> bytes:
    """Interleaved 16- or 24-bit samples of (channel, frame) in -1..1."""
    v = np.floor(np.clip(samples.astype(np.float64), -1, 1).T.reshape(-1) * ((1 << (bits - 1)) - 1) + 0.5).astype("<i4")
    return v.astype("<i2").tobytes() if bits == 16 else v.view(np.uint8).reshape(-1, 4)[:, :3].tobytes()


class PcmWriter(DataSourceArrowWriter):
    def __init__(self, options: dict[str, str]):
        self.root, self.rate, self.bits = options["path"], int(options.get("rate", 44100)), int(options.get("bits", 24))
        if self.bits not in (16, 24):
            raise Unsupported(f"{self.bits}-bit output")
        self.job = uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, base = store_of(self.root)
        out, done, open_file = None, [], None

        def close():
            if out is not None:
                out.write(open_file["tail"])
                out.close()
                if open_file["at"] != open_file["total"]:
                    raise ValueError(f"{open_file['path']}: {open_file['at']} of {open_file['total']} frames")

        try:
            for batch in iterator:
                for row in range(batch.num_rows):
                    path, start, total = (batch.column(c)[row].as_py() for c in ("path", "start", "total_frames"))
                    samples = batch.column("samples")[row].values
                    samples = np.array([c.values.to_numpy(zero_copy_only=False) if c.values is not None else [] for c in samples], dtype=np.float32)
                    if open_file is None or open_file["path"] != path:
                        close()
                        out = None
                        place = f"{base.rstrip('/')}/{path.strip('/')}"
                        folder, _, name = place.rpartition("/")
                        store.create_dir(folder, recursive=True)
                        part = f"{folder}/.{name}.{self.job}.{uuid.uuid4().hex}"
                        done.append((part, place))
                        cues = batch.column("cues")[row].as_py()
                        before, tail = wav_header(self.rate, len(samples), self.bits, total, cues)
                        out = store.open_output_stream(part)
                        out.write(before)
                        open_file = {"path": path, "at": 0, "total": total, "tail": tail, "channels": len(samples)}
                    if start != open_file["at"] or len(samples) != open_file["channels"]:
                        raise ValueError(f"{path}: a block at {start} where {open_file['at']} is next")
                    out.write(pcm_bytes(samples, self.bits))
                    open_file["at"] += samples.shape[1]
            close()
        except BaseException:
            if out is not None and not out.closed:
                out.close()
            self._remove(store, [part for part, _ in done])
            raise
        return Written(done)

    @staticmethod
    def _remove(store, parts) -> None:
        for info in store.get_file_info(list(parts)):
            if info.type == fs.FileType.File:
                store.delete_file(info.path)

    def _leftovers(self, store, base) -> None:
        """Hidden files of this job that no message names: of tasks that were lost or ran twice."""
        found = store.get_file_info(fs.FileSelector(base, recursive=True, allow_not_found=True))
        self._remove(store, [f.path for f in found if f.type == fs.FileType.File and self.job in f.base_name])

    def commit(self, messages) -> None:
        store, base = store_of(self.root)
        for message in messages:
            for part, place in message.files if message else []:
                store.move(part, place)
        self._leftovers(store, base)

    def abort(self, messages) -> None:
        self._leftovers(*store_of(self.root))


class PcmSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "pcm"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> PcmReader:
        return (PushingReader if self.options.get("pushdown") == "true" else PcmReader)(dict(self.options), schema)

    def writer(self, schema: StructType, overwrite: bool) -> PcmWriter:
        return PcmWriter(dict(self.options))


def read(spark: SparkSession, root: str, schema: str = SCHEMA, block: int = BLOCK, range_bytes: int = RANGE) -> DataFrame:
    """Blocks of the recordings below ``root``: a row of ``schema`` (columns of ``SCHEMA``) each.  A file that can't be read is one row with an error."""
    spark.dataSource.register(PcmSource)
    pushes = str(spark.conf.get(PUSHDOWN, "false")).lower()
    return spark.read.format("pcm").schema(schema).option("block", block).option("range", range_bytes).option("pushdown", pushes).load(root)


def write(blocks: DataFrame, root: str, rate: int, bits: int = 24) -> None:
    """Write blocks (path, start, samples, and cues in a file's first block if there are any) as WAV files below ``root``; all of them or none.

    A file is written by one task, which holds one block at a time; ``start`` must go on without gaps.
    """
    spark = blocks.sparkSession
    spark.dataSource.register(PcmSource)
    ends = blocks.groupBy("path").agg(F.max(F.col("start") + F.coalesce(F.size(F.get("samples", F.lit(0))), F.lit(0))).cast("long").alias("total_frames"))
    cues = F.col("cues").cast("array<int>") if "cues" in blocks.columns else F.lit(None).cast("array<int>")
    rows = blocks.withColumn("cues", cues).join(ends, "path").select("path", F.col("start").cast("long").alias("start"), F.col("samples").cast("array<array<float>>").alias("samples"), "total_frames", "cues")
    rows.repartition("path").sortWithinPartitions("path", "start").write.format("pcm").mode("append").option("rate", rate).option("bits", bits).save(root)
