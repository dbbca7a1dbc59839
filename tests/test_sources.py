import numpy as np

from sonarframe.functions import udf
from sonarframe.sources import codec, files
from sonarframe.streaming import sessions


def test_scan_and_decode(spark, tmp_path):
    (tmp_path / "loops" / "chops").mkdir(parents=True)
    x = np.sin(np.arange(2000) / 9).astype(np.float32)
    (tmp_path / "loops" / "a.wav").write_bytes(codec.encode_wav([x], 8000))
    (tmp_path / "loops" / "bad.wav").write_bytes(b"nothing")
    (tmp_path / "loops" / "chops" / "own.wav").write_bytes(b"")
    (tmp_path / "loops" / "note.txt").write_text("no")
    found = files.scan(spark, str(tmp_path), content=True)
    assert sorted(r.name for r in found.collect()) == ["a.wav", "bad.wav"]
    got = {r.path.rpartition("/")[2]: r for r in codec.decode(found).collect()}
    assert got["a.wav"].sample_rate == 8000 and len(got["a.wav"].channels[0]) == 2000
    assert got["bad.wav"].error and got["bad.wav"].channels is None


def test_udfs(spark):
    x = (np.sin(np.arange(8000) / 5) * np.exp(-(np.arange(8000) % 2000) / 300)).tolist()
    df = spark.createDataFrame([(1, x), (2, None)], "id int, signal array<float>")
    f = {r.id: r.f for r in df.select("id", udf.features(8000)("signal").alias("f")).collect()}
    assert f[1].loudness < 0 and len(f[1].fingerprint) == 5
    y = df.where("id = 1").select(udf.stretched(8000, 2.0)("signal").alias("y"), udf.beat_grid(8000, 240.0)("signal").alias("g")).first()
    assert abs(len(y.y) - 16000) < 10
    udf.register_primitives(spark, 8000)
    df.createOrReplaceTempView("signals")
    assert len(spark.sql("select primitive_derivative(signal) as y from signals where id = 1").first().y) == 8000


def test_stream_matches_batch(spark, tmp_path):
    events = spark.range(40).selectExpr("timestamp_seconds(1704067200 + id * 3600 + (id div 10) * 86400) as ts", "1L as user_id")
    events.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    q = sessions.session_regions(stream, "ts", ["user_id"]).writeStream.outputMode("append").format("memory").queryName("sessions").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert [r.n for r in spark.sql("select n from sessions order by start").collect()] == [10, 10, 10]  # the last one is still open
