"""Every query with SQL against DuckDB on the small tables."""

import glob
import os

import duckdb
import pytest

from sonarframe import queries as own

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return con


def plain(v):
    return float(f"{v:.9g}") if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(own.SQL))
def test_matches_sql(spark, duck, name):
    df = own.QUERIES[name](spark, DATA)
    found = duck.sql(own.SQL[name])
    columns = sorted(df.columns)
    assert columns == sorted(found.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=str)
    want = sorted((tuple(plain(r[found.columns.index(c)]) for c in columns) for r in found.fetchall()), key=str)
    assert got == want


def test_entry_without_llm(spark, tmp_path):
    """The rest imports and runs where the llm folders and the pipeline are gone."""
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(f"{root}/sonarframe", tmp_path / "sonarframe", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{root}/__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; assert not any(n.startswith('op') and n[2].isdigit() for n in e.queries()); assert len(e.oracle_sql()) > 50; print('fine')"
    assert "fine" in subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, env=os.environ | {"PYTHONPATH": ""}).stdout


@pytest.mark.parametrize("name", ["remix_recipes", "signal_graphs", "fx_bank", "primitive_bank", "output_stages", "stretch_wsola", "stretch_varispeed", "wav_roundtrip"])
def test_rows_of_one_small_file_are_dealt_to_tasks(spark, name, monkeypatch):
    """Rows take long to work on and are many in a batch, so a task has few, whatever file they come from."""
    monkeypatch.setattr(own, "_SAMPLES", 50 * 4096)
    monkeypatch.setattr(own, "_SEEDS", 20)
    each = {"remix_recipes": 20, "signal_graphs": 20, "fx_bank": 12, "primitive_bank": 200, "output_stages": 200}.get(name, 50)
    df = own.QUERIES[name](spark, DATA)
    table = "part" if each == 20 else "embeddings"
    assert df.rdd.getNumPartitions() == max(4, -(-spark.read.parquet(f"{DATA}/{table}.parquet").count() // each))


@pytest.mark.parametrize("name", ["stretch_vocoder", "stretch_repeat", "stretch_smear"])
def test_engines_get_few_signals_a_task(spark, name, monkeypatch):
    """A worker's memory is that of a task's signals, so it doesn't grow with the table."""
    monkeypatch.setattr(own, "_SAMPLES", 50 * 4096)
    tasks = own.QUERIES[name](spark, DATA).rdd.getNumPartitions()
    assert tasks == max(4, -(-spark.read.parquet(f"{DATA}/embeddings.parquet").count() // 50))


@pytest.mark.parametrize("name", ["stretch_vocoder", "output_stages", "stretch_wsola", "stretch_repeat"])
def test_longer_vectors_get_fewer_a_task(spark, name, monkeypatch, tmp_path):
    """Tasks are bounded by the samples that the rows have, not by those of vectors of 64 elements; rows without a vector stay."""
    monkeypatch.setattr(own, "_SAMPLES", 50 * 4096)
    rows = [(i, [0.25, -0.5] * 320) for i in range(199)] + [(199, None), (200, [])]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    df = own.QUERIES[name](spark, str(tmp_path))
    tasks = 11 if name == "output_stages" else 41
    assert df.rdd.getNumPartitions() == tasks
    if name == "output_stages":
        assert sorted(r.vec_id for r in df.select("vec_id").collect()) == list(range(201))
