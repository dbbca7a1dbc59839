"""Edit logs, draws and archives."""

import hashlib
import io
import math
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from sonarframe.operators import draws, history
from sonarframe.sources import archive


def replayed(actions, limit):
    versions, at, out = [], -1, []
    for action, v in actions:
        if action == "commit":
            versions = [*versions[: at + 1], v][-limit:]
            at = len(versions) - 1
        elif action == "undo" and at > 0:
            at -= 1
        elif action == "redo" and at < len(versions) - 1:
            at += 1
        out.append((versions[at] if at >= 0 else None, at > 0, at < len(versions) - 1))
    return out


@pytest.mark.parametrize("limit,chunk", [(4, 8), (80, 16), (2, 1), (80, 1 << 14)])
def test_replay(spark, limit, chunk):
    draw, logs = random.Random(limit + chunk), {}
    for k in ("a", None, "b"):
        weights = {"a": (3, 4, 3, 1), None: (5, 1, 1, 0), "b": (1, 4, 4, 1)}[k]
        logs[k] = [(draw.choices(["commit", "undo", "redo", None], weights)[0], f"{k}{i}" if i % 9 else None) for i in range(500 if k == "a" else 90)]
    logs["none"] = [("undo", "x"), ("redo", "y"), ("other", "z")]
    rows = [(k, i, a, v) for k, log in logs.items() for i, (a, v) in enumerate(log)]
    got = history.replay(spark.createDataFrame(rows, "k string, i int, act string, v string").repartition(5), ["k"], ["i"], "act", "v", limit, chunk).collect()
    assert len(got) == len(rows)
    for k, log in logs.items():
        found = [(r.current, r.can_undo, r.can_redo) for r in sorted((r for r in got if r.k == k), key=lambda r: r.i)]
        assert found == replayed(log, limit), k


def u(seed, *key, salt=""):
    return int(hashlib.md5("|".join([salt, str(seed), *("" if x is None else str(x) for x in key)]).encode()).hexdigest()[:13], 16) / 2**52


def test_draws_dont_depend_on_partitions(spark):
    rows = [(i % 3 or None, i, float(i % 5)) for i in range(300)]
    frame = spark.createDataFrame(rows, "k int, i int, w double")
    for parts in (1, 7):
        some = frame.repartition(parts)
        waits = {(k, i): -math.log(1 - u(9, k, i, salt="pick")) / w for k, i, w in rows if w > 0}
        order = {k: sorted((t, i) for (x, i), t in waits.items() if x == k) for k in (None, 1, 2)}
        assert {r.k: r.i for r in draws.pick(some, ["k"], "w", ["i"], 9).collect()} == {k: o[0][1] for k, o in order.items()}
        assert {(r.k, r.draw): r.i for r in draws.sample(some, ["k"], "w", ["i"], 20, 9).collect()} == {(k, n + 1): i for k, o in order.items() for n, (_, i) in enumerate(o[:20])}
        places = {(r.k, r.place): r.i for r in draws.shuffled(some, ["k"], ["i"], "s", 16).collect()}
        assert places == {(k, n): i for k in (None, 1, 2) for n, (_, i) in enumerate(sorted((u("s", x, i, salt="shuffle"), i) for x, i, _ in rows if x == k))}
        chosen = {r.i: r.c for r in some.select("i", draws.choose(4, ["i"], ["x", "y", "z"], [1, 0, 3]).alias("c")).collect()}
        assert chosen == {i: "x" if u(4, i) * 4 < 1 else "z" for _, i, _ in rows}


def test_draws_follow_weights(spark):
    rows = spark.range(8000).selectExpr("id as g").crossJoin(spark.createDataFrame([(0, 1.0), (1, 3.0), (2, 0.0)], "o int, w double"))
    counts = {r.o: r["count"] for r in draws.pick(rows, ["g"], "w", ["o"], 1).groupBy("o").count().collect()}
    assert set(counts) == {0, 1} and counts[1] / 8000 == pytest.approx(0.75, abs=0.02)
    with pytest.raises(ValueError):
        draws.choose(1, ["g"], ["a"], [0.0])


@pytest.mark.parametrize("method", [archive.DEFLATED, archive.STORED])
def test_archives_open(spark, tmp_path, method):
    draw = random.Random(1)
    rows = [("a/b", f"é{i:03}.wav", bytes(draw.randrange(256) for _ in range(draw.randrange(400))) * 3) for i in range(120)] + [("c", "one", None), ("c", "two", b"")]
    frame = spark.createDataFrame(rows, "folder string, name string, content binary").repartition(6)
    found = archive.parts(frame, method).collect()
    for folder in ("a/b", "c"):
        pieces = sorted((r.offset, bytes(r.bytes)) for r in found if r.folder == folder)
        assert all(sum(len(b) for _, b in pieces[:i]) == o for i, (o, _) in enumerate(pieces))
        z = zipfile.ZipFile(io.BytesIO(b"".join(b for _, b in pieces)))
        assert z.testzip() is None
        assert {n: z.read(n) for n in z.namelist()} == {n: c or b"" for f, n, c in rows if f == folder}
    done = archive.write(frame, str(tmp_path / "out"), method).collect()
    assert sorted(r.path for r in done) == [str(tmp_path / "out" / "a/b.zip"), str(tmp_path / "out" / "c.zip")]
    for r in done:
        assert zipfile.ZipFile(r.path).testzip() is None and len(open(r.path, "rb").read()) == r.bytes
    assert archive.parts(frame.limit(0)).count() == 0


def test_offsets_are_sums_of_sizes(spark):
    frame = spark.createDataFrame([("f", "b", b"12"), ("f", "a", b"123"), ("f", "ç", b"")], "folder string, name string, content binary")
    got = {r.name: (r.offset, r.packed) for r in archive.entries(frame, archive.STORED).collect()}
    assert got == {"a": (0, 3), "b": (54, 2), "ç": (107, 0)}
    assert frame.select(archive.entry_size(F.octet_length("name"), F.length("content")).alias("s")).agg(F.sum("s")).first()[0] == 159
