"""Exact, near and substring deduplication against brute force and SQL."""

import glob
import hashlib
import itertools
import os
import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from sonarframe.llm import exact_dedup, near_dedup, queries, substring_dedup

DATA = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, digest string, kmer int, node string, keep string"  # columns that clash with the operators' own
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def table(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1, "y", "z") for i, t in rows], SCHEMA)


def words(draw, n, vocabulary=400):
    return [f"w{draw.randrange(vocabulary)}" for _ in range(n)]


@pytest.fixture(scope="module")
def rows():
    """Copies, near copies, shared passages, repeated rows, nulls, blanks, a long text, words in other scripts."""
    draw, out = random.Random(4), []
    base, passage = words(draw, 160), words(draw, 70)
    for i in range(12):
        copy = list(base)
        for _ in range(draw.randrange(4)):
            copy[draw.randrange(len(copy))] = f"n{draw.randrange(9999)}"
        out.append(" ".join(copy))
    out += [" ".join(words(draw, 30 * i) + passage + words(draw, 40)) for i in range(4)]
    out += [" ".join(words(draw, 3000)), None, "", "  \t\n", "one two", "one two", "ONE two", "É é \u00a0x y z w", "a b c d e", "A b c d e f", " ".join(["same"] * 300), " ".join(["same"] * 120)]
    out += [out[0], out[13]]
    numbered = list(enumerate(out))
    return numbered + [numbered[3], numbered[17]]


def test_exact(spark, rows):
    got = exact_dedup.digest(table(spark, rows)).collect()
    assert len(got) == len(rows)
    by = {}
    for i, t in rows:
        by.setdefault(t or "", []).append(i)
    for r, (i, t) in zip(sorted(got, key=lambda r: r.doc_id), sorted(rows, key=lambda r: r[0])):
        ids = by[t or ""]
        assert (r.doc_id, r.keep_id, r.group_size, r.kept) == (i, max(ids), len(ids), i == max(ids))
        assert r.text_sha256 == hashlib.sha256((t or "").encode()).hexdigest()


def test_exact_checks_full_bytes(spark, rows):
    """With a digest that says nothing, texts still decide; and several batches give what one gives."""
    got = exact_dedup.duplicates(table(spark, rows), digest=lambda t: F.lit("same"))
    want = exact_dedup.duplicates(table(spark, rows).repartition(5), max_files_per_trigger=1)
    key = ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert sorted(map(tuple, got.select(key).collect())) == sorted(map(tuple, want.select(key).collect()))


def test_exact_keeps_one_of_repeated_rows(spark, rows, tmp_path):
    table(spark, rows).write.parquet(str(tmp_path / "d"))
    kept = exact_dedup.deduplicate(spark.read.parquet(str(tmp_path / "d")))
    assert kept.columns == [f.split()[0] for f in SCHEMA.split(", ")]
    assert sorted(r.text or "" for r in kept.collect()) == sorted({t or "" for _, t in rows})


def test_exact_empty(spark):
    assert exact_dedup.digest(table(spark, [])).count() == 0
    assert exact_dedup.digest(spark.createDataFrame([(None, "a"), (1, "a")], "doc_id long, text string")).where("kept").first().doc_id == 1


def brute_near(rows):
    fold = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    sets = {}
    for i, t in rows:
        w = WORD.findall((t or "").translate(fold))
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    parent = {i: i for i in sets}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in itertools.combinations(sets, 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= 75 * len(sets[a] | sets[b]):
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    return {i: (len(s), find(i)) for i, s in sets.items()}


def test_near(spark, rows):
    want = brute_near(rows)
    got = near_dedup.near_duplicates(table(spark, rows)).collect()
    assert len(got) == len(rows)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def chained(draw):
    """Groups of near copies, some drifting away from their first text step by step, and unlike texts of the same words."""
    out = []
    for _ in range(5):
        text = words(draw, 90, 3000)
        for _ in range(25):
            if draw.random() < 0.5:
                text = list(text)
            for _ in range(draw.randrange(1, 5)):
                text[draw.randrange(len(text))] = f"n{draw.randrange(9999)}"
            out.append(" ".join(text))
        out += [" ".join(text[:60] + words(draw, 20)), " ".join(text[20:]), " ".join(text[:30] + words(draw, 60))]
    return list(enumerate(out))


@pytest.mark.parametrize("most", [64, 0])
def test_near_blocks(spark, rows, monkeypatch, most):
    """Groups cut into many blocks, or compared band by band, give what one block gives."""
    monkeypatch.setattr(near_dedup, "BLOCK_NODES", 3)
    monkeypatch.setattr(near_dedup, "MOST_BLOCKS", most)
    for table_rows in (rows, chained(random.Random(14))):
        assert {r.doc_id: r.component_id for r in near_dedup.near_duplicates(table(spark, table_rows)).collect()} == {i: c for i, (_, c) in brute_near(table_rows).items()}


def test_near_one_id_with_two_texts(spark, rows):
    """Rows with one id are one node: what either text is like, is linked with the other."""
    a, b = "a b c d e f g h i j k l m n o p q r s t", "z y x w v u t s r q p o n m l k j i h g"
    got = near_dedup.near_duplicates(table(spark, [(5, a), (5, b), (3, a + " more"), (9, b + " more"), (7, rows[0][1])])).collect()
    assert {(r.doc_id, r.component_id, r.kept) for r in got} == {(5, 3, False), (3, 3, True), (9, 3, False), (7, 7, True)}
    assert len(got) == 5


def test_near_null_id_and_empty(spark):
    got = near_dedup.near_duplicates(spark.createDataFrame([(None, "a b c d e f"), (2, "a b c d e f")], "doc_id long, text string")).collect()
    assert {(r.doc_id, r.component_id, r.kept) for r in got} == {(None, None, True), (2, 2, True)}
    assert near_dedup.near_duplicates(table(spark, [])).count() == 0


def test_estimate_is_corrected():
    import numpy as np

    draw = np.random.default_rng(1)
    for share in (0.5, 0.75, 0.9):
        n = 4000
        common = draw.integers(0, 2**63, int(n * share), dtype=np.int64).astype(np.uint64) * np.uint64(2)
        own = [draw.integers(0, 2**63, n - len(common), dtype=np.int64).astype(np.uint64) * np.uint64(2) for _ in range(2)]
        a, b = (np.frombuffer(near_dedup.pack(near_dedup.minima(np.concatenate([common, o]))), dtype=np.uint64) for o in own)
        true = len(common) / (2 * n - len(common))
        assert abs(near_dedup.estimate(a, b[None, :])[0] - true) < 0.12


def brute_spans(rows, window=50):
    tokens = {i: WORD.findall(t or "") for i, t in rows}
    first = {}
    for i, w in tokens.items():
        for k in range(len(w) - window + 1):
            key = tuple(w[k : k + window])
            first[key] = min(first.get(key, i), i)
    out = {}
    for i, w in tokens.items():
        gone = set()
        for k in range(len(w) - window + 1):
            if first[tuple(w[k : k + window])] < i:
                gone.update(range(k, k + window))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out[i] = (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


def test_substring(spark, rows):
    got = substring_dedup.digest(table(spark, rows)).collect()
    assert len(got) == len(rows)
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in got} == brute_spans(rows)


def test_substring_empty_and_null(spark):
    assert substring_dedup.digest(table(spark, [])).count() == 0
    text = " ".join(f"w{i}" for i in range(60))
    got = substring_dedup.digest(spark.createDataFrame([(None, text), (1, text), (2, text), (3, None)], "doc_id long, text string")).collect()
    assert {(r.doc_id, r.n_removed) for r in got} == {(None, 0), (1, 0), (2, 60), (3, 0)}


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, name):
    con = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    df = queries.queries()[name](spark, DATA)
    found = con.sql(queries.oracle_sql()[name])
    columns = sorted(df.columns)
    assert columns == sorted(found.columns)
    assert sorted(tuple(r[c] for c in columns) for r in df.collect()) == sorted(tuple(r[found.columns.index(c)] for c in columns) for r in found.fetchall())


def test_state_is_committed_as_changes_in_one_file(spark, tmp_path):
    """A commit of a store is one file, written without links read by other processes; a later run of the stream goes on from it."""
    schema = "doc_id long, digest string, file string, row long"
    arrived, checkpoint = str(tmp_path / "in"), str(tmp_path / "checkpoint")
    before = {k: spark.conf.get(k, None) for k in exact_dedup.STREAM_SETTINGS | exact_dedup.LOCAL_SETTINGS}
    assert exact_dedup._mounted(spark, checkpoint)
    for at in range(2):
        spark.createDataFrame([(i + 40 * at, f"d{i % 7}", "f", i) for i in range(40)], schema).write.mode("append").parquet(arrived)
        exact_dedup.keyed_state(spark.readStream.schema(schema).parquet(arrived), checkpoint, str(tmp_path / "out"))
    found = spark.read.parquet(str(tmp_path / "out")).groupBy("digest").agg(F.max("group_size").alias("n"), F.max("keep.doc_id").alias("last")).collect()
    assert {r.digest: (r.n, r["last"]) for r in found} == {f"d{k}": (2 * len(range(k, 40, 7)), 40 + max(range(k, 40, 7))) for k in range(7)}
    files = [f for f in glob.glob(f"{checkpoint}/state/**/*", recursive=True) if os.path.isfile(f)]
    assert any(f.endswith(".changelog") for f in files) and not any(f.endswith((".zip", ".sst")) for f in files)
    assert before == {k: spark.conf.get(k, None) for k in before}
