"""Streams with late data: what comes within the watermark counts, what comes after it doesn't, and the rest is the batch's."""

import datetime

from sonarframe.streaming import sessions


def at(hours):
    return datetime.datetime(2024, 1, 1) + datetime.timedelta(hours=hours)


def run(spark, tmp_path, batches, transform):
    schema = "ts timestamp, user_id long, value double"
    out = []
    folder = tmp_path / "in"
    folder.mkdir()
    stream = spark.readStream.schema(schema).parquet(str(folder))
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(folder))
        q = transform(stream).writeStream.outputMode("append").foreachBatch(lambda df, n: out.extend(df.collect())).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        q.awaitTermination()
    return out


def test_late_rows_within_the_watermark_join_their_session(spark, tmp_path):
    batches = [
        [(at(0), 1, 1.0), (at(1), 1, 1.0), (at(4), 1, 1.0)],
        [(at(2.5), 1, 1.0)],  # late, but by less than two hours
        [(at(40), 1, 1.0)],  # moves the watermark past the session
        [(at(3), 1, 1.0)],  # too late
        [(at(80), 2, 1.0)],
    ]
    got = run(spark, tmp_path, batches, lambda s: sessions.session_regions(s, "ts", ["user_id"], "2 hours", "2 hours"))
    assert sorted((r.user_id, r.start, r.end, r.n) for r in got) == [(1, at(0), at(4), 4), (1, at(40), at(40), 1)]


def test_envelope_of_a_stream_is_the_batchs(spark, tmp_path):
    rows = [(at(i / 3), i % 2, float(i % 7)) for i in range(60)]
    batches = [rows[:25], rows[25:45], rows[45:], [(at(99), 0, 0.0)]]
    schema = "ts timestamp, user_id long, value double"
    got = run(spark, tmp_path, batches, lambda s: sessions.rms_envelope(s, "ts", "value", ["user_id"]))
    want = sessions.rms_envelope(spark.createDataFrame(rows, schema), "ts", "value", ["user_id"]).collect()
    key = lambda r: (r.user_id, r.start, r.end, round(r.rms, 9), r.n)
    assert sorted(map(key, got)) == sorted(map(key, want))
