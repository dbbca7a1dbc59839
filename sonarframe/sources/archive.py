"""Zip archives made in parallel: entries are packed wherever they are, and put together by their offsets.

An entry is packed by the task that has it; its place in the archive is the sum of the
sizes before it (``chunks.running_sum``), and the central directory follows from names,
sizes, checksums and offsets.  Archives are parts (folder, offset, bytes) that only have to stand one after the other.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sonarframe.operators.chunks import running_sum
from sonarframe.sources.pcm import store_of
from sonarframe.work import table

STORED, DEFLATED = 0, 8
#: 1980-01-01, the earliest date of the format: archives don't change with the day they're made on.
_DATE = (1 << 5) | 1
_UTF8, _MOST = 0x800, 0xFFFFFFFF


def _local(name: bytes, method: int, crc: int, packed: int, size: int) -> bytes:
    """A header and the 64-bit sizes that always follow the name."""
    extra = struct.pack("<HHQQ", 1, 16, size, packed)
    return struct.pack("<4s5H3I2H", b"PK\3\4", 45, _UTF8, method, 0, _DATE, crc, _MOST, _MOST, len(name), len(extra)) + name + extra


def _central(name: bytes, method: int, crc: int, packed: int, size: int, offset: int) -> bytes:
    extra = struct.pack("<HHQQQ", 1, 24, size, packed, offset)
    return struct.pack("<4s6H3I5H2I", b"PK\1\2", 45, 45, _UTF8, method, 0, _DATE, crc, _MOST, _MOST, len(name), len(extra), 0, 0, 0, 0, _MOST) + name + extra


def _end(entries: int, size: int, offset: int) -> bytes:
    """The 64-bit end of the central directory, its locator, and the plain end."""
    wide = struct.pack("<4sQ2H2I4Q", b"PK\6\6", 44, 45, 45, 0, 0, entries, entries, size, offset) + struct.pack("<4sIQI", b"PK\6\7", 0, offset + size, 1)
    few = min(entries, 0xFFFF)
    return wide + struct.pack("<4s4H2IH", b"PK\5\6", 0, 0, few, few, min(size, _MOST), min(offset, _MOST), 0)


def entry_size(name_bytes, packed) -> F.Column:
    """Bytes of an entry with its header."""
    return F.lit(30 + 20).cast("long") + name_bytes + packed


def entries(outputs: DataFrame, method: int = DEFLATED) -> DataFrame:
    """(folder, name, crc, size, packed, offset, body): every output (folder, name, content) packed, with its place in the folder's archive, by name.

    A null content is empty.  Names are unique in a folder (``claim_names``).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                folder, name, content = (batch.column(c)[row].as_py() for c in ("folder", "name", "content"))
                content, packer = content or b"", zlib.compressobj(6, zlib.DEFLATED, -15)
                body = packer.compress(content) + packer.flush() if method == DEFLATED else content
                yield pa.RecordBatch.from_pylist([{"folder": folder, "name": name, "crc": zlib.crc32(content), "size": len(content), "packed": len(body), "body": body}], schema=shape)

    shape = pa.schema([("folder", pa.string()), ("name", pa.string()), ("crc", pa.int64()), ("size", pa.int64()), ("packed", pa.int64()), ("body", pa.binary())])
    packed = table(outputs.select("folder", "name", F.col("content").cast("binary").alias("content")).mapInArrow(run, "folder string, name string, crc long, size long, packed long, body binary"), "packed")
    places = running_sum(packed.drop("body", "crc", "size"), ["folder"], ["name"], entry_size(F.octet_length("name"), F.col("packed")), "offset")
    places = places.select(F.col("folder").alias("__f"), F.col("name").alias("__n"), "offset")
    return packed.join(places, F.col("folder").eqNullSafe(F.col("__f")) & (F.col("name") == F.col("__n"))).drop("__f", "__n")


def parts(outputs: DataFrame, method: int = DEFLATED) -> DataFrame:
    """(folder, offset, bytes): archives as parts, entries first, then their central directory, then its end."""
    found = table(entries(outputs, method), "entries")

    def headed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                yield pa.RecordBatch.from_pylist([{"folder": r["folder"], "offset": r["offset"], "bytes": _local(r["name"].encode(), method, r["crc"], r["packed"], r["size"]) + r["body"]}], schema=shape)

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            yield pa.RecordBatch.from_pylist([{"folder": r["folder"], "offset": r["at"], "bytes": _central(r["name"].encode(), method, r["crc"], r["packed"], r["size"], r["offset"])} for r in rows], schema=shape)

    def ended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_pylist([{"folder": r["folder"], "offset": r["starts"] + r["length"], "bytes": _end(r["n"], r["length"], r["starts"])} for r in batch.to_pylist()], schema=shape)

    shape = pa.schema([("folder", pa.string()), ("offset", pa.int64()), ("bytes", pa.binary())])
    schema = "folder string, offset long, bytes binary"
    line = F.lit(46 + 28).cast("long") + F.octet_length("name")
    sizes = found.select("folder", "name", "crc", "size", "packed", "offset")
    totals = sizes.groupBy("folder").agg(F.sum(entry_size(F.octet_length("name"), F.col("packed"))).alias("starts"), F.sum(line).alias("length"), F.count("*").alias("n"))
    directory = running_sum(sizes, ["folder"], ["name"], line, "behind")
    directory = directory.join(totals.select(F.col("folder").alias("__f"), "starts"), F.col("folder").eqNullSafe(F.col("__f"))).withColumn("at", F.col("starts") + F.col("behind")).drop("__f")
    return found.mapInArrow(headed, schema).unionByName(directory.select("folder", "name", "crc", "size", "packed", "offset", "at").mapInArrow(listed, schema)).unionByName(totals.mapInArrow(ended, schema))


def write(outputs: DataFrame, root: str, method: int = DEFLATED) -> DataFrame:
    """Write one archive ``folder``.zip for each folder below ``root``, at once; (path, bytes) of each, as a table.

    Packing is done by all tasks; a task then writes one archive part after part, to a hidden file that is moved to its place.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = store_of(root)
        out, now, part, size, done = None, None, "", 0, []

        def close():
            if out is not None:
                out.close()
                path = f"{base.rstrip('/')}/{now}.zip"
                store.move(part, path)
                done.append((path, size))

        for batch in batches:
            for folder, offset, piece in zip(*(batch.column(c).to_pylist() for c in ("folder", "offset", "bytes"))):
                if out is None or folder != now:
                    close()
                    now, size = folder, 0
                    above = f"{base.rstrip('/')}/{folder}".rpartition("/")[0]
                    store.create_dir(above, recursive=True)
                    part = f"{above}/.{folder.rpartition('/')[2]}.{uuid.uuid4().hex}"
                    out = store.open_output_stream(part)
                if offset != size:
                    raise ValueError(f"{folder}: a part at {offset} where {size} is next")
                out.write(piece)
                size += len(piece)
        close()
        yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in done], pa.string()), pa.array(np.array([n for _, n in done], dtype=np.int64))], ["path", "bytes"])

    pieces = parts(outputs, method).repartition("folder").sortWithinPartitions("folder", "offset")
    return table(pieces.mapInArrow(run, "path string, bytes long"), "archives")
