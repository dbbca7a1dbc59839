"""Long recordings in parts: as much as in one piece, whole output or none."""

import os
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from sonarframe.sources import codec, pcm


def aiff(x, bits, rate=8000, kind=None):
    data = np.floor(np.asarray(x).T.reshape(-1) * 32767 + 0.5).astype("<i2" if kind == b"sowt" else ">i2").tobytes()
    common = struct.pack(">HIH", len(x), len(x[0]), bits) + struct.pack(">HQ", 16383 + 12, int(rate * 2.0 ** (63 - 12))) + (kind + b"\0\0" if kind else b"")
    body = (b"AIFC" if kind else b"AIFF") + b"COMM" + struct.pack(">I", len(common)) + common + b"SSND" + struct.pack(">III", 8 + len(data), 0, 0) + data
    return b"FORM" + struct.pack(">I", len(body)) + body


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("pcm")
    draw = np.random.default_rng(1)
    x = draw.uniform(-1, 1, (2, 5003))
    (root / "a").mkdir()
    (root / "a" / "chops").mkdir()
    for bits in (16, 24):
        (root / "a" / f"w{bits}.wav").write_bytes(codec.encode_wav(list(x), 8000, bits, [3, 99]))
    floats = x.T.astype("<f4").tobytes()
    (root / "f.wav").write_bytes(b"RIFF\0\0\0\0WAVELIST" + struct.pack("<I", 3) + b"abc\0fmt " + struct.pack("<IHHIIHH", 16, 3, 2, 9000, 0, 8, 32) + b"data" + struct.pack("<I", len(floats)) + floats)
    (root / "b.aiff").write_bytes(aiff(x, 16))
    (root / "c.aif").write_bytes(aiff(x, 16, kind=b"sowt"))
    (root / "cut.wav").write_bytes(codec.encode_wav(list(x), 8000, 16)[:9000])
    (root / "empty.wav").write_bytes(codec.encode_wav([[]], 8000, 16))
    (root / "bad.wav").write_bytes(b"not audio")
    (root / "mp3.aif").write_bytes(aiff(x, 16, kind=b"mp3 "))
    (root / "a" / "chops" / "own.wav").write_bytes(codec.encode_wav(list(x), 8000, 16))
    return root


@pytest.mark.parametrize("block,size", [(1 << 16, 64 << 20), (100, 1000), (7, 64), (1000, 37)])
def test_parts_give_what_the_whole_gives(spark, folder, block, size):
    rows = pcm.read(spark, str(folder), block=block, range_bytes=size)
    whole = {p: codec.decode_bytes(p.read_bytes()) for p in folder.rglob("*") if p.is_file() and p.name not in ("bad.wav", "mp3.aif", "empty.wav") and "chops" not in str(p)}
    got, errors = {}, {}
    for r in rows.collect():
        errors[r.path] = r.error
        if not r.error:
            got.setdefault(r.path, []).append(r)
    assert {os.path.basename(p) for p, e in errors.items() if e} == {"bad.wav", "mp3.aif"}
    assert [(r.frames, r.total_frames, r.samples) for r in got.pop(str(folder / "empty.wav"))] == [(0, 0, [])]
    assert set(got) == {str(p) for p in whole}
    for path, (rate, x) in whole.items():
        blocks = sorted(got[str(path)], key=lambda r: r.start)
        assert [r.start for r in blocks] == list(range(0, x.shape[1], block))
        assert all(r.sample_rate == rate and r.total_frames == x.shape[1] for r in blocks)
        assert np.array_equal(np.concatenate([np.array(r.samples, dtype=np.float32) for r in blocks], axis=1), x)
    assert size > 5000 or rows.rdd.getNumPartitions() > 100


def test_columns_and_filters_that_arent_read(spark, folder):
    reader = pcm.PcmSource({"path": str(folder), "range": "1000", "block": "100", "pushdown": "true"}).reader(spark.createDataFrame([], "path string, start long").schema)
    every = len(reader.partitions())
    rest = list(reader.pushFilters([pcm.EqualTo(("path",), str(folder / "b.aiff")), pcm.GreaterThan(("start",), 900), pcm.LessThanOrEqual(("start",), 1200), pcm.EqualTo(("frames",), 3)]))
    assert [f.attribute for f in rest] == [("frames",)] and len(reader.partitions()) < every / 4
    rows = [r for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]
    assert rows == [{"path": str(folder / "b.aiff"), "start": s} for s in (1000, 1100, 1200)]
    before = spark.conf.get(pcm.PUSHDOWN)
    spark.conf.set(pcm.PUSHDOWN, "true")
    try:
        found = pcm.read(spark, str(folder), "path string, start long, frames int", 100, 1000).where((F.col("path") == str(folder / "b.aiff")) & (F.col("start") >= 4900))
        assert sorted((r.start, r.frames) for r in found.collect()) == [(4900, 100), (5000, 3)]
    finally:
        spark.conf.set(pcm.PUSHDOWN, before)


@pytest.mark.parametrize("bits", [16, 24])
def test_written_files_are_those_of_one_piece(spark, tmp_path, bits):
    draw = np.random.default_rng(2)
    made, rows = {}, []
    for name, channels, n in (("x/long.wav", 2, 1000), ("y.wav", 1, 1), ("none.wav", 1, 0)):
        x = draw.uniform(-1.2, 1.2, (channels, n)).astype(np.float32)
        made[name] = codec.encode_wav(list(x), 8000, bits, [5, 2000] if n == 1000 else None)
        rows += [(name, s, x[:, s : s + 90].tolist(), [5, 2000] if n == 1000 and not s else None) for s in range(0, max(n, 1), 90)]
    pcm.write(spark.createDataFrame(rows, "path string, start long, samples array<array<float>>, cues array<int>").repartition(4), str(tmp_path / "out"), 8000, bits)
    assert {str(p.relative_to(tmp_path / "out")): p.read_bytes() for p in (tmp_path / "out").rglob("*") if p.is_file()} == made


def test_a_failed_write_leaves_nothing(spark, tmp_path):
    (tmp_path / "out").mkdir()
    (tmp_path / "out" / "b.wav").write_bytes(b"earlier")
    good = [("a.wav", s, [[0.5] * 10]) for s in range(0, 50, 10)]
    bad = [("b.wav", 0, [[0.5] * 10]), ("b.wav", 30, [[0.5] * 10])]
    with pytest.raises(Exception, match="where 10 is next"):
        pcm.write(spark.createDataFrame(good + bad, "path string, start long, samples array<array<float>>"), str(tmp_path / "out"), 8000)
    assert [(p.name, p.read_bytes()) for p in (tmp_path / "out").rglob("*")] == [("b.wav", b"earlier")]


def test_a_commit_takes_one_of_two_attempts(tmp_path):
    writer = pcm.PcmWriter({"path": str(tmp_path), "rate": "8000", "bits": "16"})
    batch = pcm.pa.RecordBatch.from_pylist([{"path": "a.wav", "start": 0, "samples": [[0.25, 0.5]], "total_frames": 2, "cues": None}])
    batch = batch.set_column(4, "cues", pcm.pa.nulls(1, pcm.pa.list_(pcm.pa.int32())))
    first, _ = writer.write(iter([batch])), writer.write(iter([batch]))
    assert len(list(tmp_path.iterdir())) == 2
    writer.commit([first, None])
    assert [p.name for p in tmp_path.iterdir()] == ["a.wav"]
    writer.abort([])
    assert (tmp_path / "a.wav").read_bytes() == codec.encode_wav([[0.25, 0.5]], 8000, 16)
