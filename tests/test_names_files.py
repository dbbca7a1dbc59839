"""Names claimed by families, and files written at once."""

import random

import pytest

from sonarframe.plans import sequential
from sonarframe.sources import files


@pytest.mark.parametrize("chunk", [1, 16, 1 << 16])
def test_claimed_as_one_after_another(spark, chunk):
    draw = random.Random(chunk)
    names = ["loop.wav", "Loop.wav", "loop 2.wav", "loop 2 2.wav", "kick", "kick 3", "KICK", "a.b.wav", ".hidden", ".hidden 2", "x 02.wav", "x.wav", "lone.wav", "é.aif", "é 2.AIF", "é.AIF"]
    rows = [(draw.choice(["d", "e", None]), draw.choice(names), i) for i in range(400)] + [("same", "hot.wav", i) for i in range(1000, 1300)] + [("d", None, 900)]
    got = sequential.claim_names(spark.createDataFrame(rows, "dir string, name string, i int").repartition(5), "dir", "name", "i", chunk).collect()
    assert len(got) == len(rows)
    for d in ("d", "e", None, "same"):
        own = sorted((r for r in got if r.dir == d and r.name is not None), key=lambda r: r.i)
        assert [r.unique_name for r in own] == sequential.claim([r.name for r in own])


def test_writing_and_removing_are_actions(spark, tmp_path):
    outputs = spark.createDataFrame([("x", "1.wav", b"abc"), ("x/y", "2.wav", b""), ("", "3.wav", b"z")], "directory string, name string, content binary")
    done = files.write(outputs, str(tmp_path))
    assert sorted(str(p.relative_to(tmp_path)) for p in tmp_path.rglob("*.wav")) == ["3.wav", "x/1.wav", "x/y/2.wav"]
    (tmp_path / "x" / "1.wav").write_bytes(b"newer")
    assert sorted((r.path, r.bytes) for r in done.collect()) == sorted([(str(tmp_path / "x/1.wav"), 3), (str(tmp_path / "x/y/2.wav"), 0), (str(tmp_path / "3.wav"), 1)])
    assert (tmp_path / "x" / "1.wav").read_bytes() == b"newer"  # reading what was done doesn't write again
    gone = files.remove(outputs.select("directory", "name").union(spark.createDataFrame([("x", "9.wav")], "directory string, name string")), str(tmp_path))
    assert not list(tmp_path.rglob("*.wav"))
    assert sorted(r.removed for r in gone.collect()) == [False, True, True, True]
