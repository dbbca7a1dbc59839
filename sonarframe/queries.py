"""Registered queries of the library's own operators, each with its SQL for the test tables.

The test tables hold no recordings.  Signals are derived from event data: the
hourly sum of ``events.value`` (whole, or per type or user) is a frame series, users'
event times are onsets and regions, vectors are short signals.  The comment at each
query says which rows of the operator inventory (section 2 of the survey) it covers.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sonarframe.functions import levels, music, naming, tempo
from sonarframe.functions.numbers import clamp, half_up, step_at
from sonarframe.operators import aggregates, chunks, frames, inclusion, intervals, matching, selection, slices

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _seconds(ts: str = "ts") -> Column:
    return F.unix_micros(F.col(ts).cast("timestamp")) / 1_000_000


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "events").withColumn("t", _seconds()).withColumn("h", F.floor(F.col("t") / 3600))


def _hourly(spark: SparkSession, sf_dir: str, *keys: str) -> DataFrame:
    return _events(spark, sf_dir).groupBy(*keys, "h").agg(F.sum(F.col("value").cast("decimal(12,2)")).cast("double").alias("x"))


_E = "e AS (SELECT *, epoch_us(ts) / 1000000 AS t, CAST(floor(epoch_us(ts) / 3600000000) AS BIGINT) AS h FROM events)"
_H = _E + ", s AS (SELECT h, CAST(sum(CAST(value AS DECIMAL(12,2))) AS DOUBLE) AS x FROM e GROUP BY h)"
_HT = _E + ", s AS (SELECT event_type, h, CAST(sum(CAST(value AS DECIMAL(12,2))) AS DOUBLE) AS x FROM e GROUP BY ALL)"
_DB = "CASE WHEN x > 1e-9 THEN 20 * log10(x) ELSE -180 END"


def r6(x) -> Column:
    return F.round(x, 6)


# 109 (hopping rms), 83
@_query(f"WITH {_HT} SELECT event_type, h, round(sqrt(avg(x * x) OVER (PARTITION BY event_type ORDER BY h RANGE BETWEEN CURRENT ROW AND 2 FOLLOWING)), 6) AS rms FROM s")
def rms_envelope(spark, sf_dir):
    hops = frames.hop_sums(_hourly(spark, sf_dir, "event_type"), ["event_type"], F.col("h"), "x").withColumnRenamed("hop", "h")
    return frames.envelope(hops, ["event_type"], "h", "x", 3).select("event_type", "h", r6("rms").alias("rms"))


# 156, 157, 158
@_query(f"WITH {_H} SELECT h, round({_DB}, 6) AS db, round(CASE WHEN x / 1000 > 1e-9 THEN 20 * log10(x / 1000) ELSE -120 END, 6) AS loud, round(pow(10, ({_DB}) / 20), 6) AS lin FROM s")
def lin_to_db(spark, sf_dir):
    return _hourly(spark, sf_dir).select("h", r6(levels.to_db("x")).alias("db"), r6(levels.to_db(F.col("x") / 1000, levels.LOUDNESS_FLOOR_DB)).alias("loud"), r6(levels.from_db(levels.to_db("x"))).alias("lin"))


# 81
@_query(f"WITH {_HT}, d AS (SELECT event_type, {_DB} AS db, row_number() OVER (PARTITION BY event_type ORDER BY x) - 1 AS r, count(*) OVER (PARTITION BY event_type) AS n FROM s) SELECT event_type, round(db, 6) AS floor_db FROM d WHERE r = least(n - 1, CAST(floor(n * 0.10) AS BIGINT))")
def noise_floor(spark, sf_dir):
    rows = _hourly(spark, sf_dir, "event_type").withColumn("db", levels.to_db("x"))
    return frames.noise_floor(rows, ["event_type"], "db").withColumn("floor_db", r6("floor_db"))


# 82
@_query("WITH d AS (SELECT l_returnflag, l_extendedprice AS p, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice) - 1 AS r, count(*) OVER (PARTITION BY l_returnflag) AS n FROM lineitem) SELECT l_returnflag, p AS price FROM d WHERE r = CAST(floor((n - 1) * 0.82) AS BIGINT)")
def percentile_index(spark, sf_dir):
    return frames.percentile(_table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_extendedprice", 0.82, "price")


_CURVE = "c AS (SELECT event_type, h, x, greatest(0, coalesce(log10(x + 1) - lag(log10(x + 1)) OVER (PARTITION BY event_type ORDER BY h), 0)) AS strength FROM s)"


# 110
@_query(f"WITH {_HT}, {_CURVE} SELECT event_type, h, round(strength, 6) AS strength FROM c")
def onset_curve(spark, sf_dir):
    return frames.onset_curve(_hourly(spark, sf_dir, "event_type"), ["event_type"], "h", "x").select("event_type", "h", r6("strength").alias("strength"))


# 111
@_query(f"""WITH {_E}, s AS (SELECT user_id AS k, h, CAST(sum(CASE WHEN event_type = 'click' THEN CAST(value AS DECIMAL(12,2)) ELSE 0 END) AS DOUBLE) AS a, CAST(sum(CAST(value AS DECIMAL(12,2))) AS DOUBLE) AS b FROM e GROUP BY user_id, h),
d AS (SELECT k, h, greatest(0, coalesce(log10(a + 1) - lag(log10(a + 1)) OVER w, 0)) AS da, greatest(0, coalesce(log10(b + 1) - lag(log10(b + 1)) OVER w, 0)) AS db FROM s WINDOW w AS (PARTITION BY k ORDER BY h)),
r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY da) - 1 AS ra, row_number() OVER (PARTITION BY k ORDER BY db) - 1 AS rb, count(*) OVER (PARTITION BY k) AS n FROM d),
na AS (SELECT k, da AS v FROM r WHERE ra = CAST(floor((n - 1) * 0.82) AS BIGINT)), nb AS (SELECT k, db AS v FROM r WHERE rb = CAST(floor((n - 1) * 0.82) AS BIGINT))
SELECT k, h, round(da / greatest(1e-6, na.v) + d.db / greatest(1e-6, nb.v), 6) AS strength FROM d JOIN na USING (k) JOIN nb USING (k)""")
def multi_band_onset_curve(spark, sf_dir):
    value = F.col("value").cast("decimal(12,2)")
    rows = _events(spark, sf_dir).groupBy(F.col("user_id").alias("k"), "h").agg(F.sum(F.when(F.col("event_type") == "click", value).otherwise(0)).cast("double").alias("a"), F.sum(value).cast("double").alias("b"))
    return frames.combined_onset_curve(rows, ["k"], "h", ["a", "b"]).select("k", "h", r6("strength").alias("strength"))


_PEAKS = """p AS (SELECT *, lag(strength) OVER w AS b, lead(strength) OVER w AS a FROM c WINDOW w AS (PARTITION BY event_type ORDER BY h)),
q AS (SELECT event_type, strength, row_number() OVER (PARTITION BY event_type ORDER BY strength) - 1 AS r, count(*) OVER (PARTITION BY event_type) AS n FROM c),
l AS (SELECT event_type, greatest(0.025, strength * 0.65) AS lim FROM q WHERE r = CAST(floor((n - 1) * 0.82) AS BIGINT)),
peaks AS (SELECT event_type, h, strength FROM p JOIN l USING (event_type) WHERE strength >= lim AND strength >= b AND strength >= a)"""


# 112: threshold and local maxima
@_query(f"WITH {_HT}, {_CURVE}, {_PEAKS} SELECT event_type, h, round(strength, 6) AS strength FROM peaks")
def pick_onsets(spark, sf_dir):
    curve = frames.onset_curve(_hourly(spark, sf_dir, "event_type"), ["event_type"], "h", "x")
    return frames.onset_peaks(curve, ["event_type"], "h", "strength").select("event_type", "h", r6("strength").alias("strength"))


# 112: spacing from the last onset kept
@_query(f"""WITH RECURSIVE {_HT}, {_CURVE}, {_PEAKS}, kept AS (
SELECT event_type, min(h) AS h FROM peaks GROUP BY event_type UNION ALL
SELECT k.event_type, (SELECT min(p.h) FROM peaks p WHERE p.event_type = k.event_type AND p.h >= k.h + 6) AS h FROM kept k WHERE (SELECT min(p.h) FROM peaks p WHERE p.event_type = k.event_type AND p.h >= k.h + 6) IS NOT NULL)
SELECT event_type, CAST(h AS DOUBLE) AS h FROM kept""")
def debounced_onsets(spark, sf_dir):
    curve = frames.onset_curve(_hourly(spark, sf_dir, "event_type"), ["event_type"], "h", "x")
    peaks = frames.onset_peaks(curve, ["event_type"], "h", "strength")
    return chunks.debounce(peaks.select("event_type", F.col("h").cast("double").alias("h")), ["event_type"], "h", 6.0, 1 << 12)


# 113
@_query(f"WITH {_HT} SELECT event_type, h, round(avg(CASE WHEN {_DB} > -180 THEN {_DB} END) OVER (PARTITION BY event_type ORDER BY h ROWS BETWEEN 11 PRECEDING AND CURRENT ROW), 6) AS reference_db FROM s")
def moving_reference(spark, sf_dir):
    rows = _hourly(spark, sf_dir, "event_type").withColumn("db", levels.to_db("x"))
    return frames.moving_reference(rows, ["event_type"], "h", "db", 12).select("event_type", "h", r6("reference_db").alias("reference_db"))


# 126
@_query(f"WITH {_HT}, f AS (SELECT event_type, h, greatest(0, coalesce(x - lag(x) OVER (PARTITION BY event_type ORDER BY h), 0)) AS rise FROM s), g AS (SELECT *, max(rise) OVER (PARTITION BY event_type) AS top FROM f) SELECT event_type, h, round(CASE WHEN top > 0 THEN rise / top ELSE 0 END, 6) AS flux FROM g")
def onset_flux(spark, sf_dir):
    return frames.peak_normalised_flux(_hourly(spark, sf_dir, "event_type"), ["event_type"], "h", "x").select("event_type", "h", r6("flux").alias("flux"))


# 116, 125
@_query(f"""WITH {_HT}, d AS (SELECT *, {_DB} AS db, row_number() OVER (PARTITION BY event_type ORDER BY x) - 1 AS r, count(*) OVER (PARTITION BY event_type) AS n, max(x) OVER (PARTITION BY event_type) AS top FROM s),
f AS (SELECT event_type, db AS fl FROM d WHERE r = least(n - 1, CAST(floor(n * 0.10) AS BIGINT)))
SELECT event_type, coalesce(min(h) FILTER (db >= fl + 12), 0) AS start, min(h) FILTER (x >= top * 0.2) AS first_onset FROM d JOIN f USING (event_type) GROUP BY event_type""")
def audible_start(spark, sf_dir):
    rows = _hourly(spark, sf_dir, "event_type")
    return frames.first_audible(rows, ["event_type"], "h", "x").join(frames.first_onset(rows, ["event_type"], "h", "x"), "event_type")


# 36
@_query(f"""WITH {_HT}, g AS (SELECT event_type, avg({_DB}) AS m FROM s GROUP BY event_type), l AS (SELECT event_type, h, ({_DB}) >= round(m, 6) AS loud FROM s JOIN g USING (event_type)),
a AS (SELECT *, CASE WHEN loud = lag(loud) OVER w THEN 0 ELSE 1 END AS new FROM l WINDOW w AS (PARTITION BY event_type ORDER BY h)), b AS (SELECT *, sum(new) OVER (PARTITION BY event_type ORDER BY h) AS run FROM a),
c AS (SELECT event_type, run, loud OR count(*) < 2 AS inside, min(h) AS f, max(h) AS t FROM b GROUP BY event_type, run, loud), d AS (SELECT *, coalesce(lead(f) OVER w, t + 1) AS e, CASE WHEN inside = lag(inside) OVER w THEN 0 ELSE 1 END AS new FROM c WINDOW w AS (PARTITION BY event_type ORDER BY run)),
i AS (SELECT *, sum(new) OVER (PARTITION BY event_type ORDER BY run) AS isle FROM d) SELECT event_type, CAST(min(f) AS DOUBLE) AS "start", CAST(max(e) AS DOUBLE) AS "end" FROM i WHERE inside GROUP BY event_type, isle""")
def silence_regions(spark, sf_dir):
    rows = _hourly(spark, sf_dir, "event_type").withColumn("db", levels.to_db("x"))
    gate = rows.groupBy("event_type").agg(r6(F.avg("db")).alias("gate"))
    found = intervals.islands(rows.join(gate, "event_type"), ["event_type"], "h", F.col("db") >= F.col("gate"), 1.0, 2.0)
    return found.select("event_type", F.col("start").cast("double").alias("start"), F.col("end").cast("double").alias("end"))


_SESSION = f"{_E}, n AS (SELECT user_id, t, CASE WHEN t - lag(t) OVER (PARTITION BY user_id ORDER BY t) >= 21600 THEN 1 WHEN lag(t) OVER (PARTITION BY user_id ORDER BY t) IS NULL THEN 1 ELSE 0 END AS new FROM e), m AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY t) AS i FROM n), ses AS (SELECT user_id, i, min(t) AS \"start\", max(t) AS \"end\", count(*) AS n FROM m GROUP BY user_id, i)"


def _sessions(spark, sf_dir):
    return intervals.sessions(_events(spark, sf_dir), ["user_id"], "t", 21600.0)


# 115: session segmentation by gaps
@_query(f'WITH {_SESSION} SELECT user_id, "start", "end", n FROM ses')
def session_regions(spark, sf_dir):
    return _sessions(spark, sf_dir).select("user_id", "start", "end", "n")


# 47
@_query(f"""WITH {_SESSION}, a AS (SELECT *, CASE WHEN "start" - lag("end") OVER (PARTITION BY user_id ORDER BY "start", "end") > 43200 THEN 1 WHEN lag("end") OVER (PARTITION BY user_id ORDER BY "start", "end") IS NULL THEN 1 ELSE 0 END AS fresh FROM ses), b AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY "start", "end") AS g FROM a)
SELECT user_id, min("start") AS "start", max("end") AS "end" FROM b GROUP BY user_id, g""")
def merge_regions(spark, sf_dir):
    return intervals.merge(_sessions(spark, sf_dir), ["user_id"], 43200.0).select("user_id", "start", "end")


# 37
@_query(f'WITH {_SESSION} SELECT user_id, greatest(0, "start" - 600) AS "start", least(1706745600.0::DOUBLE, "end" + 600) AS "end" FROM ses WHERE least(1706745600.0::DOUBLE, "end" + 600) - greatest(0, "start" - 600) >= 7200')
def pad_filter(spark, sf_dir):
    return intervals.pad_and_filter(_sessions(spark, sf_dir), 600.0, 7200.0, F.lit(1706745600.0)).select("user_id", "start", "end")


# 74, 65
@_query(f"WITH {_E} SELECT event_id, CASE WHEN abs(floor(t / 900 + 0.5) * 900 - t) <= 200 THEN floor(t / 900 + 0.5) * 900 ELSE t END AS snapped, (floor(t / 900 + 1e-9) + 1) * 900 AS next_line FROM e")
def grid_snap(spark, sf_dir):
    return _events(spark, sf_dir).select("event_id", tempo.snap_to_grid("t", 900.0, 0.0, 200.0).alias("snapped"), tempo.grid_line("t", 900.0, 0.0, 1).cast("double").alias("next_line"))


# 76, 122, 123
@_query("""WITH o AS (SELECT o_orderkey, date_diff('day', DATE '1990-01-01', CAST(o_orderdate AS DATE)) AS d FROM orders)
SELECT o_orderkey, CAST(floor(d / 16.0) + 1 AS BIGINT) AS bar, CAST(floor((d % 16) / 4.0) + 1 AS BIGINT) AS beat, CAST(d % 4 + 1 AS BIGINT) AS sixteenth, round((d % 8) * 4 * (60.0 / (60 + d % 100)), 6) AS seconds FROM o WHERE d % 8 > 0""")
def grid_position(spark, sf_dir):
    d = F.datediff(F.col("o_orderdate").cast("date"), F.lit("1990-01-01").cast("date"))
    rows = _table(spark, sf_dir, "orders").withColumn("d", d).where("d % 8 > 0")
    at = tempo.grid_position(F.col("d") / 4, 60.0)
    return rows.select("o_orderkey", at.bar.alias("bar"), at.beat.cast("long").alias("beat"), at.sixteenth.cast("long").alias("sixteenth"), r6(tempo.bars_to_seconds(F.col("d") % 8, 60 + F.col("d") % 100)).alias("seconds"))


# 49
@_query('SELECT p_partkey, i AS n, i * (p_retailprice / p_size) AS "start", CASE WHEN i = p_size - 1 THEN p_retailprice ELSE (i + 1) * (p_retailprice / p_size) END AS "end" FROM (SELECT *, unnest(range(0, p_size)) AS i FROM part)')
def equal_slices(spark, sf_dir):
    rows = _table(spark, sf_dir, "part").select("p_partkey", F.posexplode(intervals.equal_slices(F.lit(0.0), "p_retailprice", "p_size")).alias("n", "r"))
    return rows.select("p_partkey", F.col("n").cast("long").alias("n"), F.col("r.start").alias("start"), F.col("r.end").alias("end"))


# 85, 86
@_query(f"""WITH {_HT}, z AS (SELECT min(h) AS h0 FROM s), v AS (SELECT event_type, h - h0 AS i, x FROM s, z), b AS (SELECT unnest(range(0, 48)) AS bin), p AS (SELECT bin, unnest(range(CAST(floor(bin * 15.0) AS BIGINT), CASE WHEN bin = 47 THEN 720 ELSE greatest(CAST(floor(bin * 15.0) AS BIGINT) + 1, CAST(floor((bin + 1) * 15.0) AS BIGINT)) END)) AS i FROM b)
SELECT t.event_type, CAST(b.bin AS INTEGER) AS bin, coalesce(max(abs(x)), 0) AS peak FROM (SELECT DISTINCT event_type FROM s) t CROSS JOIN b LEFT JOIN (SELECT event_type, bin, x FROM v JOIN p USING (i)) q ON q.event_type = t.event_type AND q.bin = b.bin GROUP BY ALL""")
def peaks_in_range(spark, sf_dir):
    rows = _hourly(spark, sf_dir, "event_type")
    rows = rows.crossJoin(F.broadcast(rows.agg(F.min("h").alias("h0")))).withColumn("i", F.col("h") - F.col("h0"))
    return aggregates.peaks(rows, ["event_type"], "i", "x", 0, 720, 48)


_STRENGTH = "CASE WHEN i % 16 = 0 THEN 1.0::DOUBLE WHEN i % 4 <> 0 THEN CASE WHEN i % 2 = 0 THEN 0.1::DOUBLE + 0.25::DOUBLE * 0.5::DOUBLE ELSE 0.1::DOUBLE + 0.25::DOUBLE * 0.25::DOUBLE END WHEN i % 16 = 8 THEN 0.75::DOUBLE ELSE 0.55::DOUBLE END"


# 134, 135, 120 in kind
_COUNTS = """f AS (SELECT p_partkey, CAST(floor(p_retailprice * 100 + 0.5) AS BIGINT) AS samples, 60 + p_size AS bpm FROM part), w AS (SELECT *, samples / 10000.0::DOUBLE / ((60::DOUBLE / bpm) * 4 / 16) AS want FROM f),
n AS (SELECT *, greatest(16, floor(want / 16 + 0.5) * 16) AS nb, greatest(4, floor(want / 4 + 0.5) * 4) AS nq FROM w), c AS (SELECT *, CAST(greatest(1, least(512, CASE WHEN abs(want - nb) / want <= 0.02 THEN nb WHEN abs(want - nq) / want <= 0.02 THEN nq ELSE greatest(1, floor(want + 0.5)) END)) AS INTEGER) AS cnt, CASE WHEN abs(want - nb) / want <= 0.02 THEN 'bar' WHEN abs(want - nq) / want <= 0.02 THEN 'beat' ELSE 'slice' END AS aligned FROM n)"""


def _part_files(spark, sf_dir):
    return _table(spark, sf_dir, "part").select("p_partkey", half_up(F.col("p_retailprice") * 100).alias("samples"), F.lit(10000).alias("sample_rate"), (60 + F.col("p_size")).cast("double").alias("bpm"), F.lit("1/16").alias("subdivision"))


@_query(f"""WITH {_COUNTS},
x AS (SELECT *, unnest(range(0, cnt)) AS i FROM c) SELECT p_partkey, cnt AS "count", aligned, CAST(i AS INTEGER) AS slice, CAST(floor(i * samples / cnt + 0.5) AS BIGINT) AS start_sample, CAST(floor((i + 1) * samples / cnt + 0.5) AS BIGINT) AS end_sample, round({_STRENGTH}, 6) AS strength FROM x""")
def slice_map(spark, sf_dir):
    return slices.slice_map(_part_files(spark, sf_dir)).select("p_partkey", "count", "aligned", "slice", "start_sample", "end_sample", r6("strength").alias("strength"))


# 137 to 142
@_query(f"""WITH {_COUNTS}, l AS (SELECT p_partkey, cnt, t.level, CASE WHEN t.level = 'phrase' THEN cnt ELSE t.span END AS span FROM c, (VALUES ('phrase', 0), ('bar', 16), ('halfBar', 8), ('beat', 4), ('halfBeat', 2), ('slice', 1), ('micro', 1)) t(level, span) WHERE t.level = 'phrase' OR t.span * 2 <= cnt),
x AS (SELECT *, unnest(range(0, CAST(ceil(cnt / span) AS BIGINT))) AS k FROM l), y AS (SELECT *, CAST(k * span AS INTEGER) AS i, least(cnt, (k + 1) * span) AS e FROM x)
SELECT p_partkey, level, CAST(k AS INTEGER) AS "index", i AS "start", CAST(e AS INTEGER) AS "end", e % 16 = 0 OR e >= cnt AS ends_bar, e >= cnt AS ends_phrase, i % 16 = 0 AS is_downbeat, i % 4 = 0 AS is_beat, round({_STRENGTH}, 6) AS strength FROM y""")
def slice_hierarchy(spark, sf_dir):
    bar = slices.per_bar("subdivision")
    files = _part_files(spark, sf_dir).select("p_partkey", bar.alias("per_bar"), slices.per_beat(bar).alias("per_beat"), slices.slice_count("samples", "sample_rate", "bpm", bar)["count"].alias("count"))
    return slices.hierarchy(files, ["p_partkey"]).withColumn("strength", r6("strength"))


# 70
@_query(f"""WITH {_E}, a AS (SELECT * FROM e WHERE event_type = 'error'), p AS (SELECT user_id, t FROM e WHERE event_type = 'purchase'),
m AS (SELECT a.event_id, p.t AS m, abs(p.t - a.t) AS d, row_number() OVER (PARTITION BY a.event_id ORDER BY abs(p.t - a.t), p.t) AS r FROM a JOIN p ON p.user_id = a.user_id AND abs(p.t - a.t) <= 86400)
SELECT a.event_id, m.m AS matched, d AS distance FROM a LEFT JOIN m ON m.event_id = a.event_id AND r = 1""")
def nearest_match(spark, sf_dir):
    e = _events(spark, sf_dir)
    left, right = e.where("event_type = 'error'"), e.where("event_type = 'purchase'")
    return matching.nearest(left, right, ["user_id"], "t", "t", 86400.0, "event_id").select("event_id", "matched", "distance")


# 72, 73
@_query(f"""WITH {_E}, a AS (SELECT event_id, user_id, t AS low, t + 43200 AS high FROM e WHERE event_type = 'error'),
m AS (SELECT a.event_id, e.t, row_number() OVER (PARTITION BY a.event_id ORDER BY e.value, e.t) AS r FROM a JOIN e ON e.user_id = a.user_id AND e.t >= low AND e.t <= high AND e.event_type <> 'error')
SELECT a.event_id, coalesce(m.t, low + 21600) AS cut FROM a LEFT JOIN m ON m.event_id = a.event_id AND r = 1""")
def range_argmin(spark, sf_dir):
    e = _events(spark, sf_dir)
    bands = e.where("event_type = 'error'").select("event_id", "user_id", F.col("t").alias("low"), (F.col("t") + 43200).alias("high"))
    found = matching.range_argmin(bands, e.where("event_type <> 'error'"), ["user_id"], "low", "high", "t", "value", "event_id", F.col("low") + 21600, 43200.0)
    return found.select("event_id", "cut")


# 67, 68, 69
@_query("SELECT e.event_id, coalesce(c.c_acctbal, nullif(e.value, 0)) AS bpm, CASE WHEN c.c_custkey IS NULL THEN 'detected' ELSE 'manual' END AS source FROM events e LEFT JOIN customer c ON c.c_custkey = e.user_id AND c.c_acctbal > 0")
def effective_source(spark, sf_dir):
    overrides = _table(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("user_id"), "c_acctbal")
    rows = _table(spark, sf_dir, "events").join(overrides, "user_id", "left")
    return rows.select("event_id", tempo.effective("c_acctbal", "value").alias("bpm"), F.when(F.col("c_acctbal").isNull(), "detected").otherwise("manual").alias("source"))


# 78
@_query(f"""WITH {_SESSION} SELECT a.user_id, a."start" AS l_start, b."start" AS r_start FROM ses a JOIN (SELECT user_id, "start" + 3600 AS "start", "end" + 3600 AS "end" FROM ses) b ON a.user_id = b.user_id AND a."start" < b."end" + 60 AND a."end" > b."start" - 60""")
def overlap_join(spark, sf_dir):
    s = _sessions(spark, sf_dir).select("user_id", "start", "end")
    shifted = s.select("user_id", (F.col("start") + 3600).alias("start"), (F.col("end") + 3600).alias("end"))
    return matching.overlaps(s, shifted, ["user_id"], 86400.0, 60.0).select("user_id", F.col("l.start").alias("l_start"), F.col("r.start").alias("r_start"))


# 71, 77
@_query(f"""WITH {_SESSION} SELECT e.event_id, ses."start" FROM e JOIN ses ON e.user_id = ses.user_id AND e.t >= ses."start" AND e.t < ses."end" """)
def containment_join(spark, sf_dir):
    return matching.contained(_events(spark, sf_dir), _sessions(spark, sf_dir), ["user_id"], "t", 86400.0).select("event_id", "start")


# 25 to 34, 79
@_query("SELECT c_custkey FROM customer c WHERE coalesce(nullif(c_acctbal > 0, false), c_mktsegment <> 'BUILDING') AND EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey)")
def semi_filter(spark, sf_dir):
    flagged = _table(spark, sf_dir, "customer").withColumn("included", F.coalesce(F.nullif(F.col("c_acctbal") > 0, F.lit(False)), F.col("c_mktsegment") != "BUILDING"))
    used = _table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return inclusion.variation_set(inclusion.included_files(flagged), used, "c_custkey").select("c_custkey")


# 29, 34
@_query("SELECT c_mktsegment, NOT bool_or(c_acctbal > 9990) AS none FROM customer GROUP BY c_mktsegment")
def none_included(spark, sf_dir):
    return _table(spark, sf_dir, "customer").groupBy("c_mktsegment").agg((~F.bool_or(F.col("c_acctbal") > 9990)).alias("none"))


# 100
@_query(f"WITH {_HT}, z AS (SELECT event_type, h % 8760 AS q, x FROM s), p AS (SELECT event_type, sum(x * cos(2 * pi() / 24 * q)) AS re, sum(x * sin(2 * pi() / 24 * q)) AS im, sum(x) AS tot FROM z GROUP BY event_type), f AS (SELECT *, atan2(im, re) / (2 * pi() / 24) AS ph FROM p) SELECT event_type, round(sqrt(re * re + im * im) / tot, 6) AS coherence, round(ph - 24 * floor(ph / 24), 6) AS phase FROM f")
def phasor(spark, sf_dir):
    rows = _hourly(spark, sf_dir, "event_type").withColumn("q", F.col("h") % 8760)
    return aggregates.phasor(rows, ["event_type"], "q", "x", 24.0).select("event_type", r6("coherence").alias("coherence"), r6("phase").alias("phase"))


# 101
@_query("SELECT o_orderstatus, round(regr_slope(o_totalprice, o_custkey), 6) AS slope, round(regr_intercept(o_totalprice, o_custkey), 4) AS intercept FROM orders GROUP BY o_orderstatus")
def ols_fit(spark, sf_dir):
    return aggregates.line(_table(spark, sf_dir, "orders"), ["o_orderstatus"], "o_custkey", "o_totalprice").select("o_orderstatus", r6("slope").alias("slope"), F.round("intercept", 4).alias("intercept"))


# 99
@_query("WITH p AS (SELECT l_returnflag, ((l_orderkey - 1) % 4 + 4) % 4 AS cls, sum(l_quantity) AS l, sum(l_linenumber) AS h FROM lineitem GROUP BY ALL), t AS (SELECT l_returnflag, sum(l) AS tl, sum(h) AS th FROM p GROUP BY ALL) SELECT l_returnflag, cls, round(l / tl - h / th, 6) AS kick FROM p JOIN t USING (l_returnflag)")
def class_share(spark, sf_dir):
    found = aggregates.class_shares(_table(spark, sf_dir, "lineitem"), ["l_returnflag"], F.pmod(F.col("l_orderkey") - 1, F.lit(4)), "l_quantity", "l_linenumber")
    return found.withColumn("kick", r6("kick"))


# 254
@_query("""WITH h AS (SELECT l_orderkey, l_linenumber, l_quantity / 50 AS a, l_discount * 5 AS b, l_tax * 6 AS c, (l_linenumber % 5) * 0.15::DOUBLE AS d FROM lineitem), r AS (SELECT *, CASE WHEN a + b + c > 1e-9 THEN a + b + c END AS t FROM h)
SELECT l_orderkey, l_linenumber, CASE WHEN t IS NULL THEN 'perc' WHEN a / t >= 0.5 AND d < 0.5 THEN 'kick' WHEN c / t >= 0.45 THEN CASE WHEN d < 0.18 THEN 'hat' ELSE 'cymbal' END WHEN b / t >= 0.32 OR (a / t < 0.5 AND c / t < 0.45) THEN 'snare' ELSE 'perc' END AS label FROM r""")
def classify_hit(spark, sf_dir):
    label = aggregates.classify_hit(F.col("l_quantity") / 50, F.col("l_discount") * 5, F.col("l_tax") * 6, (F.col("l_linenumber") % 5) * F.lit(0.15))
    return _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", label.alias("label"))


# 107
@_query("SELECT l_returnflag, string_agg(l_linestatus || ' x' || n, ', ' ORDER BY l_linestatus) AS summary FROM (SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ALL) GROUP BY l_returnflag")
def label_counts(spark, sf_dir):
    counts = _table(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"))
    text = F.concat(F.col("l_linestatus"), F.lit(" x"), F.col("n"))
    return counts.groupBy("l_returnflag").agg(F.array_join(F.array_sort(F.collect_list(text)), ", ").alias("summary"))


# 89, 159
@_query(f"WITH {_HT}, m AS (SELECT event_type, max(x) AS top FROM s GROUP BY event_type), g AS (SELECT event_type, 20 * log10(sqrt(avg(x * x))) AS db FROM s JOIN m USING (event_type) WHERE x >= greatest(1e-5, top * pow(10, -25.0 / 20)) GROUP BY event_type) SELECT event_type, round(db, 6) AS loudness_db, round(pow(10, greatest(-12, least(12, -20 - (db - 60))) / 20), 6) AS gain FROM g")
def loudness_gated(spark, sf_dir):
    found = aggregates.gated_loudness(_hourly(spark, sf_dir, "event_type"), ["event_type"], "x")
    return found.select("event_type", r6("loudness_db").alias("loudness_db"), r6(levels.match_gain(F.col("loudness_db") - 60)).alias("gain"))


# 91, 92, 96, 84, 44
@_query("WITH v AS (SELECT l_returnflag, l_discount - 0.05 AS x FROM lineitem) SELECT l_returnflag, coalesce(bool_or(isnan(x)), false) AS has_nan, coalesce(bool_or(isinf(x)), false) AS has_inf, max(abs(x)) AS peak, round(sqrt(avg(x * x)), 6) AS rms, round(avg(x), 6) AS dc, sqrt(avg(x * x)) < 0.0008 AS near_silent, abs(avg(x)) > 0.35 AS extreme_dc FROM v GROUP BY l_returnflag")
def safety_stats(spark, sf_dir):
    found = _table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(*aggregates.safety(F.col("l_discount") - 0.05))
    return found.withColumn("rms", r6("rms")).withColumn("dc", r6("dc"))


# 88: centring and norm
@_query("WITH m AS (SELECT vec_id, list_transform(embedding, lambda v: CAST(v AS DOUBLE)) AS e FROM embeddings), c AS (SELECT vec_id, list_transform(e, lambda v: v - list_sum(e) / len(e)) AS c FROM m), n AS (SELECT *, sqrt(list_sum(list_transform(c, lambda v: v * v))) AS n FROM c) SELECT vec_id, round(c[1] / CASE WHEN n = 0 THEN 1 ELSE n END, 6) AS f0, round(list_max(c) / CASE WHEN n = 0 THEN 1 ELSE n END, 6) AS f_max FROM n")
def fingerprint_norm(spark, sf_dir):
    f = _table(spark, sf_dir, "embeddings").select("vec_id", aggregates.fingerprint("embedding").alias("f"))
    return f.select("vec_id", r6(F.get("f", F.lit(0))).alias("f0"), r6(F.array_max("f")).alias("f_max"))


# 93
@_query("""WITH m AS (SELECT vec_id, list_transform(embedding, lambda v: CAST(v AS DOUBLE)) AS a, list_transform(embedding, lambda v: CAST(v AS DOUBLE) * abs(CAST(v AS DOUBLE))) AS b FROM embeddings), n AS (SELECT *, greatest(1e-9, sqrt(list_sum(list_transform(a, lambda v: v * v)) / len(a))) AS na, greatest(1e-9, sqrt(list_sum(list_transform(b, lambda v: v * v)) / len(b))) AS nb FROM m)
SELECT vec_id, round(least(sqrt(list_sum(list_transform(range(1, len(a) + 1), lambda i: pow(a[i] / na - b[i] / nb, 2))) / len(a)), sqrt(list_sum(list_transform(range(1, len(a) + 1), lambda i: pow(a[i] / na + b[i] / nb, 2))) / len(a))), 6) AS novelty FROM n""")
def novelty(spark, sf_dir):
    a = F.transform("embedding", lambda v: v.cast("double"))
    b = F.transform(a, lambda v: v * F.abs(v))
    return _table(spark, sf_dir, "embeddings").select("vec_id", r6(aggregates.novelty(a, b)).alias("novelty"))


# 95
@_query("WITH m AS (SELECT vec_id, list_transform(embedding, lambda v: CAST(v AS DOUBLE)) AS e, greatest(1, len(embedding) // 3) AS n FROM embeddings), r AS (SELECT vec_id, sqrt(list_sum(list_transform(e[1:n], lambda v: v * v)) / n) AS a, sqrt(list_sum(list_transform(e[len(e) - n + 1:len(e)], lambda v: v * v)) / n) AS b FROM m) SELECT vec_id, round(CASE WHEN a > 0 THEN greatest(0, least(1, 1 - b / a)) ELSE 0 END, 6) AS contrast FROM r")
def decay_contrast(spark, sf_dir):
    return _table(spark, sf_dir, "embeddings").select("vec_id", r6(aggregates.decay_contrast(F.transform("embedding", lambda v: v.cast("double")))).alias("contrast"))


# 102
@_query(f"WITH {_E}, b AS (SELECT user_id, value, t / 900 AS p FROM e), n AS (SELECT *, floor(p + 0.5) AS n FROM b) SELECT user_id, CAST(sum(CASE WHEN abs(p - n) <= 0.12 THEN CASE WHEN CAST(n AS BIGINT) % 4 IN (1, 3) THEN CAST(value AS DECIMAL(12,2)) ELSE -0.5 * CAST(value AS DECIMAL(12,2)) END ELSE 0 END) AS DOUBLE) AS backbeat FROM n GROUP BY user_id")
def backbeat_score(spark, sf_dir):
    e = _events(spark, sf_dir).withColumn("v", F.col("value").cast("decimal(12,2)"))
    n = half_up(F.col("t") / 900)
    weight = F.when(F.abs(F.col("t") / 900 - n) <= 0.12, F.when(F.pmod(n, F.lit(4)).isin(1, 3), F.col("v")).otherwise(F.lit(-0.5).cast("decimal(2,1)") * F.col("v"))).otherwise(F.lit(0).cast("decimal(2,1)"))
    return e.groupBy("user_id").agg(F.sum(weight).cast("double").alias("backbeat"))


# 98
@_query("SELECT o_orderstatus, round(avg(CASE WHEN o_totalprice > 150000 THEN 1 ELSE 0 END), 6) AS departure FROM orders GROUP BY o_orderstatus")
def recipe_departure(spark, sf_dir):
    return _table(spark, sf_dir, "orders").groupBy("o_orderstatus").agg(r6(aggregates.departure(F.col("o_totalprice") > 150000)).alias("departure"))


# 97
@_query("SELECT l_orderkey, CASE WHEN max(l_extendedprice) > max(l_quantity) * 1000 AND max(l_extendedprice) > 0 THEN round(max(l_quantity) * 1000 / max(l_extendedprice), 6) ELSE 1 END AS gain FROM lineitem GROUP BY l_orderkey")
def level_guard(spark, sf_dir):
    return _table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(r6(aggregates.level_guard(F.max("l_quantity") * 1000, F.max("l_extendedprice"))).alias("gain"))


# 145 to 147
@_query("SELECT l_returnflag, l_orderkey, l_linenumber, l_extendedprice FROM (SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS r FROM lineitem) WHERE r <= 24")
def topk_per_group(spark, sf_dir):
    w = Window.partitionBy("l_returnflag").orderBy(F.desc("l_extendedprice"), "l_orderkey", "l_linenumber")
    return _table(spark, sf_dir, "lineitem").withColumn("r", F.row_number().over(w)).where("r <= 24").select("l_returnflag", "l_orderkey", "l_linenumber", "l_extendedprice")


_LADDER = (1.5, 2, 3, 4, 6, 8, 12, 16)


# 152
@_query("SELECT p_partkey, CAST(list_position([abs(ln(p_size / 5.0 / r)) FOR r IN [1.5, 2, 3, 4, 6, 8, 12, 16]], list_min([abs(ln(p_size / 5.0 / r)) FOR r IN [1.5, 2, 3, 4, 6, 8, 12, 16]])) - 1 AS INTEGER) AS ladder FROM part")
def nearest_ladder(spark, sf_dir):
    far = F.transform(F.array(*(F.lit(float(r)) for r in _LADDER)), lambda r: F.abs(F.ln(F.col("p_size") / 5.0 / r)))
    return _table(spark, sf_dir, "part").select("p_partkey", (F.array_position(far, F.array_min(far)) - 1).cast("int").alias("ladder"))


# 108
@_query("SELECT o_custkey, string_agg(o_orderpriority, ',' ORDER BY first) AS used FROM (SELECT o_custkey, o_orderpriority, min(o_orderkey) AS first FROM orders GROUP BY ALL) GROUP BY o_custkey")
def distinct_in_order(spark, sf_dir):
    rows = _table(spark, sf_dir, "orders").groupBy("o_custkey", "o_orderpriority").agg(F.min("o_orderkey").alias("first"))
    return rows.groupBy("o_custkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("first", "o_orderpriority"))), lambda x: x.o_orderpriority), ",").alias("used"))


_SAFE = r"trim(regexp_replace(regexp_replace({}, '[/\\:*?\"<>|,\[\]]', '-', 'g'), '\s+', ' ', 'g'))"


# 161, 162
@_query(f"WITH u AS (SELECT page_id, {_SAFE.format('url')} AS s FROM pages) SELECT page_id, CASE WHEN length(s) <= 24 THEN s ELSE regexp_replace(substr(s, 1, 24), '[\\s_-]+$', '') END AS safe FROM u")
def sanitize_path(spark, sf_dir):
    return _table(spark, sf_dir, "pages").select("page_id", naming.sanitize_for_path("url", 24).alias("safe"))


# 163, 164, 174, 175
@_query("SELECT p_partkey, array_to_string(list_filter([CASE WHEN p_size % 3 = 0 THEN NULL ELSE p_brand || CASE WHEN p_size % 2 = 0 THEN 'm' ELSE '' END END, CASE WHEN p_size % 5 = 0 THEN NULL ELSE CAST(CAST(floor(p_retailprice / 10 + 0.5) AS BIGINT) AS VARCHAR) || 'bpm' END], lambda x: x IS NOT NULL AND x <> ''), ' ') AS tag FROM part")
def key_tempo_tag(spark, sf_dir):
    key = F.when(F.col("p_size") % 3 != 0, F.col("p_brand"))
    bpm = F.when(F.col("p_size") % 5 != 0, F.col("p_retailprice") / 10)
    return _table(spark, sf_dir, "part").select("p_partkey", naming.key_tempo_tag(key, F.when(F.col("p_size") % 2 == 0, "minor"), bpm).alias("tag"))


# 165, 168, 169, 171
@_query(r"""SELECT p_partkey, p_name || ' - ' || p_brand || ' ' AS resolved, trim(regexp_replace(p_type || '  ' || p_name, '\s+', ' ', 'g')) AS folder, CASE WHEN length(CAST(p_size AS VARCHAR)) >= 2 THEN CAST(p_size AS VARCHAR) ELSE lpad(CAST(p_size AS VARCHAR), 2, '0') END AS num FROM part""")
def resolve_pattern(spark, sf_dir):
    values = {"name": F.col("p_name"), "folder": F.col("p_type"), "tag": F.col("p_brand")}
    return _table(spark, sf_dir, "part").select("p_partkey", naming.resolve_pattern("{Name} - {tag} {key}", values).alias("resolved"), naming.resolve_folder("{folder}  {name}", values).alias("folder"), naming.padded("p_size").alias("num"))


# 172, 179, 183
@_query("WITH n AS (SELECT *, row_number() OVER (PARTITION BY p_brand, lower(p_type) ORDER BY p_partkey) AS r FROM part) SELECT p_partkey, CASE WHEN r = 1 THEN p_type ELSE p_type || ' ' || r END AS unique_name FROM n")
def unique_names(spark, sf_dir):
    return naming.numbered_names(_table(spark, sf_dir, "part"), "p_brand", "p_type", "p_partkey").select("p_partkey", "unique_name")


# 9, 173, 176, 354
@_query("SELECT p_partkey, 'lib / ' || p_brand || ' / ' || p_name AS path, regexp_replace(p_name || '.tar.wav', '^(.+)\\.[^.]*$', '\\1') AS stem, p_brand AS folder FROM part")
def source_paths(spark, sf_dir):
    return _table(spark, sf_dir, "part").select("p_partkey", naming.source_path(F.lit("lib"), "p_brand", "p_name").alias("path"), naming.stem_of(F.concat("p_name", F.lit(".tar.wav"))).alias("stem"), naming.source_folder_name("p_brand", F.lit("x"), F.lit(False)).alias("folder"))


# 3, 5, 2
@_query("SELECT split_part(regexp_replace(url, '^[a-z]+://', ''), '/', 1) AS grp, count(*) AS files, min(page_id) AS first FROM pages WHERE NOT lower(url) LIKE '%/de/%' GROUP BY 1")
def file_groups(spark, sf_dir):
    from sonarframe.sources import files

    rows = _table(spark, sf_dir, "pages").select("page_id", F.regexp_replace("url", "^[a-z]+://", "").alias("path"))
    return files.groups(rows.where(~files.excluded("path", ("de",))), "path").agg(F.count("*").alias("files"), F.min("page_id").alias("first")).withColumnRenamed("group", "grp")


_NOTES = "['C','C#','D','D#','E','F','F#','G','G#','A','A#','B']"


# 185, 186, 188, 189, 228
@_query(f"""SELECT p_partkey, {_NOTES}[p_size % 12 + 1] AS note, CAST(p_size % 12 AS INTEGER) AS idx, CAST(CASE WHEN ((p_partkey - p_size) % 12 + 12) % 12 > 6 THEN ((p_partkey - p_size) % 12 + 12) % 12 - 12 ELSE ((p_partkey - p_size) % 12 + 12) % 12 END AS BIGINT) AS semis,
CAST((p_size % 12 + CASE WHEN p_size % 2 = 0 THEN 3 ELSE -3 END + 12) % 12 AS INTEGER) AS rel, CAST([0,2,3,5,7,8,10][(p_size - 25) - 7 * CAST(floor((p_size - 25) / 7.0) AS INTEGER) + 1] + 12 * floor((p_size - 25) / 7.0) AS INTEGER) AS degree FROM part""")
def note_math(spark, sf_dir):
    size = F.col("p_size")
    return _table(spark, sf_dir, "part").select(
        "p_partkey", music.note_name(size).alias("note"), music.note_index(music.note_name(size)).alias("idx"), music.nearest_semitones(size, "p_partkey").alias("semis"),
        music.relative_root(size % 12, F.when(size % 2 == 0, "minor").otherwise("major")).cast("int").alias("rel"), music.degree_semitones(F.lit("minor"), size - 25).cast("int").alias("degree"),
    )


# 187, 190, 192, 193
@_query(f"""WITH k AS (SELECT p_partkey, CAST(p_size % 12 AS INTEGER) AS s, CAST(p_partkey % 12 AS INTEGER) AS t, CASE WHEN p_size % 2 = 0 THEN 'minor' ELSE 'major' END AS sm, CASE WHEN p_partkey % 3 = 0 THEN 'minor' ELSE 'major' END AS tm FROM part), r AS (SELECT *, CASE WHEN sm <> tm THEN (t + CASE WHEN tm = 'minor' THEN 3 ELSE -3 END + 12) % 12 ELSE t END AS root FROM k), w AS (SELECT *, (root - s + 12) % 12 AS raw FROM r)
SELECT p_partkey, CAST(CASE WHEN raw > 6 THEN raw - 12 ELSE raw END AS INTEGER) AS semitones, sm <> tm AS relative_used, {_NOTES}[root + 1] || ' ' || sm AS result FROM w""")
def transpose(spark, sf_dir):
    size, key = F.col("p_size"), F.col("p_partkey")
    sm, tm = F.when(size % 2 == 0, "min").otherwise("dur"), F.when(key % 3 == 0, "aeolian").otherwise("Major")
    rows = _table(spark, sf_dir, "part").withColumn("t", music.transposition(music.note_name(size), sm, music.note_name(key), tm))
    return rows.select("p_partkey", "t.semitones", "t.relative_used", music.format_key("t.result_key", "t.result_mode").alias("result"))


# 199, 219, 195
@_query("""WITH b AS (SELECT p_partkey, 40.0::DOUBLE + p_size * 3 AS b, 60.0::DOUBLE + p_partkey % 100 AS t FROM part), d AS (SELECT *, abs(log2(b / t)) AS d0, abs(log2(b / 2 / t)) AS dh, abs(log2(b * 2 / t)) AS dd FROM b)
SELECT p_partkey, CASE WHEN dd < (CASE WHEN dh < d0 - 0.15 THEN dh ELSE d0 END) - 0.15 THEN b * 2 WHEN dh < d0 - 0.15 THEN b / 2 END AS octave, round(b / (t / 2), 6) AS ratio FROM d""")
def octave_fix(spark, sf_dir):
    b, t = 40.0 + F.col("p_size") * 3, 60.0 + F.col("p_partkey") % 100
    return _table(spark, sf_dir, "part").select("p_partkey", tempo.better_octave(b, t).alias("octave"), r6(tempo.ratio_for(b, tempo.feel_target(t, F.lit("half")))).alias("ratio"))


# 206
@_query("""SELECT p_partkey, array_to_string(list_sort(list_distinct(list_filter([CAST(floor(b * f + 0.5) AS INTEGER) FOR f IN [0.25::DOUBLE, 0.5, 2.0::DOUBLE / 3, 1, 1.5, 2, 4]], lambda v: (v BETWEEN 30 AND 300) OR v = CAST(floor(b + 0.5) AS INTEGER)))), ',') AS readings FROM (SELECT p_partkey, p_retailprice / 10 AS b FROM part)""")
def tempo_interpretations(spark, sf_dir):
    return _table(spark, sf_dir, "part").select("p_partkey", F.array_join(tempo.interpretations(F.col("p_retailprice") / 10), ",").alias("readings"))


# 197, 198
@_query("""WITH b AS (SELECT p_partkey, p_retailprice / 100 AS d, 60.0::DOUBLE + p_size AS bpm FROM part), x AS (SELECT *, d * bpm / 60 AS beats, floor(d * bpm / 60 + 0.5) AS near FROM b),
t AS (SELECT *, [1.0::DOUBLE,2,4,8,16,32,64,128,256,512,1024] AS t1, [4.0::DOUBLE,8,12,16,20,24,28,32,40,48,56,64,80,96,112,128,160,192,256] AS t2, CASE WHEN near % 2 = 0 THEN [near] ELSE list_filter([near - 1, near + 1], lambda v: v >= 1) END AS t3, [near] AS t4 FROM x),
y AS (SELECT *, list_transform([t1, t2, t3, t4], lambda l: l[list_position(list_transform(l, lambda c: abs(c - beats)), list_min(list_transform(l, lambda c: abs(c - beats))))]) AS best FROM t),
z AS (SELECT *, list_filter(best, lambda c: c >= 1 AND abs(c * 60 / d / bpm - 1) <= 0.025)[1] AS pick FROM y)
SELECT p_partkey, round(CASE WHEN beats >= 0.5 THEN pick * 60 / d END, 6) AS bpm, CASE WHEN beats >= 0.5 THEN pick END AS beats FROM z""")
def loop_snap(spark, sf_dir):
    s = tempo.loop_snap(F.col("p_retailprice") / 100, 60.0 + F.col("p_size"))
    return _table(spark, sf_dir, "part").select("p_partkey", r6(s.bpm).alias("bpm"), s.beats.alias("beats"))


# 41, 42
@_query("SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN least(100000, c_acctbal) END AS source_bpm, CASE WHEN c_acctbal > 0 THEN greatest(1, least(100000, c_acctbal)) END AS target_bpm FROM customer")
def sanitize_bpm(spark, sf_dir):
    return _table(spark, sf_dir, "customer").select("c_custkey", tempo.source_bpm("c_acctbal").alias("source_bpm"), tempo.target_bpm("c_acctbal").alias("target_bpm"))


# 43
@_query("SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity / 50 < 0.58 THEN false WHEN l_linenumber = 7 THEN l_quantity / 50 >= 0.66 ELSE l_linenumber >= 2.5 END AS percussive FROM lineitem")
def looks_percussive(spark, sf_dir):
    confidence = F.when(F.col("l_linenumber") != 7, F.col("l_linenumber"))
    return _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", aggregates.looks_percussive(F.col("l_quantity") / 50, confidence).alias("percussive"))


# 222, 223, 224, 225
@_query("""WITH q AS (SELECT p_partkey, 5.0::DOUBLE * pow(20000.0::DOUBLE, least(1, greatest(0, p_size * 20 / 1000.0::DOUBLE))) AS p, p_retailprice AS r, p_size FROM part), t AS (SELECT *, CASE WHEN p < 1000 THEN 1.0::DOUBLE WHEN p < 10000 THEN 10 ELSE 100 END AS s FROM q)
SELECT p_partkey, floor(p / s + 0.5) * s AS pct, CAST(floor(ln(greatest(5, least(100000, r)) / 5) / ln(20000.0::DOUBLE) * 1000 + 0.5) AS BIGINT) AS slider, round(greatest(0, least(1, p_size / 100.0::DOUBLE)) * r, 6) AS mapped FROM t""")
def stretch_sliders(spark, sf_dir):
    return _table(spark, sf_dir, "part").select("p_partkey", tempo.slider_to_percent(F.col("p_size") * 20).alias("pct"), tempo.percent_to_slider("p_retailprice").alias("slider"), r6(tempo.map_position("p_size", F.lit(100.0), "p_retailprice")).alias("mapped"))


# 205, 193, 356
@_query("""SELECT p_partkey, CASE WHEN p_size = 25 THEN 'no change' ELSE CASE WHEN p_size < 25 THEN '+' ELSE '' END || printf('%.1f', sign(25 - p_size) * floor(abs((1 / (p_size / 25.0::DOUBLE) - 1) * 100) * 10 + 0.5) / 10) || CASE WHEN p_size < 25 THEN '% faster' ELSE '% slower' END END AS change, CAST(CAST(floor(p_retailprice + 0.5) AS BIGINT) AS VARCHAR) || ' BPM' || CASE WHEN p_size % 2 = 0 THEN ' (manual)' ELSE '' END AS bpm FROM part""")
def format_texts(spark, sf_dir):
    return _table(spark, sf_dir, "part").select("p_partkey", tempo.format_tempo_change(F.col("p_size") / 25).alias("change"), naming.bpm_text("p_retailprice", F.col("p_size") % 2 == 0, F.lit(True)).alias("bpm"))


# 220, 221, 23, 24, 236
@_query("SELECT event_id, '[\"' || event_type || '\",' || json_extract_string(props, '$.k') || ']' AS signature, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events")
def json_signature(spark, sf_dir):
    k = F.get_json_object("props", "$.k")
    return _table(spark, sf_dir, "events").select("event_id", F.concat(F.lit("["), F.concat_ws(",", F.concat(F.lit('"'), "event_type", F.lit('"')), k), F.lit("]")).alias("signature"), k.cast("int").alias("k"))


# 55, 155
@_query(f"""WITH {_SESSION}, l AS (SELECT user_id, "start" AS s, "end" AS e FROM ses), a AS (SELECT user_id, 1704844800.0::DOUBLE AS a FROM (SELECT DISTINCT user_id FROM l)), k AS (SELECT l.user_id, s, CASE WHEN e > a.a - 0.001 OR e > a.a THEN a.a ELSE e END AS e FROM l JOIN a USING (user_id) WHERE s < a.a - 0.001)
SELECT user_id, s AS "start", e AS "end" FROM k WHERE e - s > 0.001 UNION ALL SELECT user_id, a, a + 86400 FROM a""")
def region_splice(spark, sf_dir):
    lists = _sessions(spark, sf_dir).groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct(F.col("start"), F.col("end")))).alias("r"))
    anchor = F.lit(1704844800.0)
    new = F.array(F.struct(anchor.alias("start"), (anchor + 86400).alias("end")))
    return lists.select("user_id", F.explode(intervals.splice("r", anchor, anchor, new)).alias("x")).select("user_id", "x.start", "x.end")


# 53, 54
@_query(f"""WITH {_SESSION}, c AS (SELECT user_id, "start", "end", ("start" + "end") / 2 AS m FROM ses WHERE "end" - "start" >= 7200) SELECT user_id, "start", m AS "end" FROM c UNION ALL SELECT user_id, m, "end" FROM c""")
def split_region(spark, sf_dir):
    rows = _sessions(spark, sf_dir).select("user_id", F.array(F.struct("start", "end")).alias("r"), ((F.col("start") + F.col("end")) / 2).alias("m"))
    return rows.select("user_id", F.explode(intervals.split_at("r", "m", 3600.0)).alias("x")).select("user_id", "x.start", "x.end")


# 15, 16
@_query(f"""WITH {_SESSION} SELECT user_id, string_agg(CAST(greatest(0, least(9999, CAST(floor(("start" - 1704067200) * 0.01 + 0.5) AS BIGINT))) AS VARCHAR), ',' ORDER BY "start") AS cues, count(*) <= 128 AS ok FROM ses GROUP BY user_id""")
def cue_frames(spark, sf_dir):
    s = _sessions(spark, sf_dir).groupBy("user_id").agg(F.collect_list(F.struct((F.col("start") - 1704067200).alias("start"), "end")).alias("r"))
    return s.select("user_id", F.array_join(intervals.cue_frames("r", F.lit(0.01), F.lit(10000)), ",").alias("cues"), intervals.markers_ok(F.size("r")).alias("ok"))


# 64
@_query(f"""WITH {_E}, n AS (SELECT user_id, t, CASE WHEN t - lag(t) OVER (PARTITION BY user_id ORDER BY t) < 600.000000000001 THEN 0 ELSE 1 END AS new FROM e), m AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY t) AS i FROM n) SELECT user_id, min(t) AS boundary, count(*) AS edges FROM m GROUP BY user_id, i""")
def shared_boundaries(spark, sf_dir):
    return intervals.shared_boundaries(_events(spark, sf_dir), ["user_id"], "t", 600.0)


# 63
@_query("""WITH v AS (SELECT l_suppkey, l_orderkey * 8 + l_linenumber AS p, l_discount - 0.05::DOUBLE AS x FROM lineitem), b AS (SELECT *, lag(x) OVER (PARTITION BY l_suppkey ORDER BY p) AS y FROM v), c AS (SELECT l_suppkey, abs(p - 4000) AS d, p FROM b WHERE ((y <= 0 AND x >= 0) OR (y >= 0 AND x <= 0)) AND abs(p - 4000) <= 3000)
SELECT s.l_suppkey, CAST(4000 AS BIGINT) AS around, coalesce((SELECT arg_min(p, d * 1000000 + p) FROM c WHERE c.l_suppkey = s.l_suppkey), 4000) AS crossing FROM (SELECT DISTINCT l_suppkey FROM v) s""")
def zero_crossing(spark, sf_dir):
    rows = _table(spark, sf_dir, "lineitem").select("l_suppkey", (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("p"), (F.col("l_discount") - F.lit(0.05)).alias("x"), F.lit(4000).cast("long").alias("around"))
    return intervals.zero_crossing(rows, ["l_suppkey"], "p", "x", "around", 3000)


# 57 to 62
@_query("WITH v AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS version, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders) SELECT o_custkey, o_orderkey, version, version > 0 AS can_undo, version < n - 1 AS can_redo FROM v WHERE version > n - 1 - 5")
def edit_history(spark, sf_dir):
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    v = _table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", (F.row_number().over(w) - 1).cast("long").alias("version"))
    last = v.groupBy("o_custkey").agg(F.max("version").alias("last"))
    kept = v.join(last, "o_custkey").where(F.col("version") > F.col("last") - 5)
    return kept.select("o_custkey", "o_orderkey", "version", intervals.can_undo("version").alias("can_undo"), intervals.can_redo("version", "last").alias("can_redo"))


_V = "list_transform(embedding, lambda v: CAST(v AS DOUBLE))"


def _signal() -> Column:
    return F.transform("embedding", lambda v: v.cast("double"))


# 293, 259
@_query(f"WITH m AS (SELECT vec_id, {_V} AS e FROM embeddings), h AS (SELECT vec_id, list_transform(range(0, len(e)), lambda i: e[i - i % 3 + 1]) AS h FROM m), q AS (SELECT vec_id, list_transform(h, lambda v: floor(v / 0.03125 + 0.5) * 0.03125) AS q FROM h) SELECT vec_id, list_sum(q) AS total, q[7] AS q6, list_max(q) AS top FROM q")
def crunch_quantize(spark, sf_dir):
    rows = _table(spark, sf_dir, "embeddings").select("vec_id", levels.crunch(_signal(), 6, 3).alias("q"))
    return rows.select("vec_id", F.aggregate("q", F.lit(0.0), lambda a, b: a + b).alias("total"), F.get("q", F.lit(6)).alias("q6"), F.array_max("q").alias("top"))


# 299, 302, 316, 292 (tape)
@_query(f"""WITH m AS (SELECT vec_id, {_V} AS e FROM embeddings) SELECT vec_id, round(list_sum(list_transform(e, lambda v: tanh(v * 2) / tanh(2.0::DOUBLE))), 6) AS soft, round(list_sum(list_transform(e, lambda v: 0.5 * v + 0.5 * tanh(v * 3.5))), 6) AS tape,
round(list_sum(list_transform(e, lambda v: 0.5 * v + 0.5 * (tanh((v + 0.1) * 3.5) - tanh(0.35::DOUBLE)))), 6) AS tube, round(list_sum(list_transform(e, lambda v: 0.5 * v + 0.5 * CASE WHEN v > 0 THEN tanh(v * 10.5) ELSE greatest(-1, least(0, v * 3.5)) END)), 6) AS fuzz,
round(list_sum(list_transform(e, lambda v: CASE WHEN abs(v * 4) <= 0.98 THEN v * 4 ELSE sign(v) * (0.98 + 0.02 * tanh((abs(v * 4) - 0.98) / 0.02)) END)), 6) AS lim FROM m""")
def drive_shape(spark, sf_dir):
    total = lambda shape: r6(F.aggregate(_signal(), F.lit(0.0), lambda a, v: a + shape(v)))
    return _table(spark, sf_dir, "embeddings").select(
        "vec_id", total(lambda v: levels.soft_saturate(v, 2.0)).alias("soft"), total(lambda v: levels.drive(v, "tape", 50.0)).alias("tape"), total(lambda v: levels.drive(v, "tube", 50.0)).alias("tube"),
        total(lambda v: levels.drive(v, "fuzz", 50.0)).alias("fuzz"), total(lambda v: levels.soft_limit(v * 4)).alias("lim"),
    )


# 250, 129, 251
@_query(f"""WITH m AS (SELECT vec_id, {_V} AS e FROM embeddings), r AS (SELECT *, CAST(floor(len(e) * 0.75 + 0.5) AS INTEGER) AS n FROM m)
SELECT vec_id, CAST(n AS INTEGER) AS n, round(e[CAST(floor(5 / 0.75::DOUBLE) AS INTEGER) + 1] * (1 - (5 / 0.75::DOUBLE - floor(5 / 0.75::DOUBLE))) + e[CAST(floor(5 / 0.75::DOUBLE) AS INTEGER) + 2] * (5 / 0.75::DOUBLE - floor(5 / 0.75::DOUBLE)), 6) AS r5, e[6] AS rot0, round(e[3] * (2 / 4.0::DOUBLE), 6) AS faded FROM r""")
def array_signals(spark, sf_dir):
    x = _signal()
    r = levels.resample_linear(x, 0.75)
    return _table(spark, sf_dir, "embeddings").select("vec_id", F.size(r).alias("n"), r6(F.get(r, F.lit(5))).alias("r5"), F.get(levels.rotate(x, 5), F.lit(0)).alias("rot0"), r6(F.get(levels.fades(x, 4, 8), F.lit(2))).alias("faded"))


# 217, 218, 237, 238
@_query("SELECT p_partkey, round(pow(2, (p_size - 24) / 12.0::DOUBLE), 6) AS ratio, round(12 * log2(p_retailprice / 100), 6) AS st, round(20 * pow(1000.0::DOUBLE, p_size / 50.0::DOUBLE), 4) AS hz, round(greatest(0, least(1, ln(p_retailprice / 20) / ln(1000.0::DOUBLE))), 6) AS pos FROM part")
def ratios_and_curves(spark, sf_dir):
    return _table(spark, sf_dir, "part").select("p_partkey", r6(levels.semitones_to_ratio((F.col("p_size") - 24).cast("double"))).alias("ratio"), r6(levels.ratio_to_semitones(F.col("p_retailprice") / 100)).alias("st"), F.round(levels.curve(20.0, 20000.0, F.col("p_size") / 50.0, True), 4).alias("hz"), r6(levels.uncurve(20.0, 20000.0, "p_retailprice", True)).alias("pos"))


# 38, 39, 40, 35
@_query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' THEN o_custkey % 2 = 0 ELSE o_custkey % 2 = 0 OR o_custkey % 3 = 0 OR o_custkey % 5 = 0 END AS active, o_custkey % 2 = 0 AND o_custkey % 7 = 0 AS secondary FROM orders")
def output_scope(spark, sf_dir):
    k = F.col("o_custkey")
    task = F.when(F.col("o_orderstatus") == "O", "chop").otherwise("stretch")
    return _table(spark, sf_dir, "orders").select("o_orderkey", inclusion.lofi_active(task, k % 2 == 0, k % 3 == 0, k % 5 == 0).alias("active"), inclusion.clean_secondary(k % 2 == 0, k % 7 == 0).alias("secondary"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


# kernels on signals: no SQL states them, so they are checked by invariants in the tests


#: Samples, and rows that a kernel makes a result from without a signal, of one task: files are small for the work on their rows.
_SAMPLES, _SEEDS = 1 << 20, 1 << 12


def _spread(rows: DataFrame, most: int, size: Column | None = None) -> DataFrame:
    """``rows`` dealt to tasks of about ``most``, counted in rows or in what ``size`` says a row has, and as many tasks as the cluster has cores."""
    count, mean = rows.agg(F.count(F.lit(1)), F.avg(F.lit(1) if size is None else F.greatest(size, F.lit(0)))).first()
    each = max(1, int(most // max(1, mean or 1)))
    return rows.repartition(max(rows.sparkSession.sparkContext.defaultParallelism, -(-count // each)))


def _tones(spark: SparkSession, sf_dir: str, repeat: int = 64) -> DataFrame:
    """Vectors as short signals: each repeated (64 elements to 4,096 samples) and windowed by a decay, at 8 kHz."""
    x = F.transform("embedding", lambda v: v.cast("double"))
    long = F.flatten(F.array_repeat(x, repeat))
    rows = _spread(_table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), _SAMPLES, F.size("embedding") * repeat)
    return rows.select("vec_id", F.transform(long, lambda v, i: (v * F.exp(-(i % 1024) / 300.0) * 0.5).cast("float")).alias("signal"))


# 10 to 16
@_query()
def wav_roundtrip(spark, sf_dir):
    from sonarframe.sources import codec

    rows = _tones(spark, sf_dir)
    pack = F.pandas_udf(lambda s: s.map(lambda x: codec.encode_wav([x], 8000, 24, [0, 100])), "binary")
    files = rows.select(F.concat(F.col("vec_id").cast("string"), F.lit(".wav")).alias("path"), pack("signal").alias("content"))
    return codec.decode(files).select("path", "sample_rate", F.size(F.get("channels", F.lit(0))).alias("frames"), "error")


# 87, 88, 90, 114 to 121, 124
@_query()
def signal_features(spark, sf_dir):
    from sonarframe.functions import udf

    return _tones(spark, sf_dir).select("vec_id", udf.features(8000)("signal").alias("f")).select("vec_id", "f.*")


@_query()
def signal_onsets(spark, sf_dir):
    from sonarframe.functions import udf

    return _tones(spark, sf_dir).select("vec_id", udf.onsets(8000)("signal").alias("onsets"), udf.phrases(8000, {"shortest": 0.1})("signal").alias("phrases"), F.size(udf.one_shots(8000)("signal")).alias("hits"))


# 75, 146: whole vectors as fingerprints
@_query(f"""WITH RECURSIVE m AS (SELECT label, vec_id, {_V} AS e FROM embeddings), b AS (SELECT label, vec_id, sqrt(list_sum(list_transform(e, lambda v: v * v))) AS peak, list_transform(e, lambda v: v - list_avg(e)) AS c FROM m),
v AS (SELECT label, vec_id, peak, list_transform(c, lambda x: x / sqrt(list_sum(list_transform(c, lambda y: y * y)))) AS v FROM b), l AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS i FROM (SELECT *, max(peak) OVER (PARTITION BY label) AS top FROM v) WHERE peak >= top * 0.08::DOUBLE),
r AS (SELECT label, i, vec_id, peak, vec_id AS leader, [{{'id': vec_id, 'v': v}}] AS found FROM l WHERE i = 1 UNION ALL
SELECT l.label, l.i, l.vec_id, l.peak, coalesce(list_filter(r.found, lambda f: 1 - list_inner_product(f.v, l.v) <= 0.06::DOUBLE)[1].id, l.vec_id), CASE WHEN len(list_filter(r.found, lambda f: 1 - list_inner_product(f.v, l.v) <= 0.06::DOUBLE)) > 0 THEN r.found ELSE list_append(r.found, {{'id': l.vec_id, 'v': l.v}}) END FROM r JOIN l ON l.label = r.label AND l.i = r.i + 1),
best AS (SELECT label, leader, vec_id, peak FROM r QUALIFY row_number() OVER (PARTITION BY label, leader ORDER BY peak DESC, vec_id) = 1)
SELECT label, vec_id, round(peak, 6) AS peak FROM best QUALIFY row_number() OVER (PARTITION BY label ORDER BY peak DESC, leader) <= 24""")
def dedupe_greedy(spark, sf_dir):
    rows = _table(spark, sf_dir, "embeddings").select("label", "vec_id", aggregates.fingerprint("embedding").alias("fingerprint"), F.sqrt(F.aggregate(_signal(), F.lit(0.0), lambda a, v: a + v * v)).alias("peak"))
    return selection.dedupe(rows, ["label"], "vec_id", "fingerprint", "peak").select("label", "vec_id", r6("peak").alias("peak"))


# 255 to 289: one query for each engine
def _stretch_query(name: str, character: str):
    def run(spark, sf_dir):
        from sonarframe.functions import udf

        made = _tones(spark, sf_dir).select("vec_id", udf.stretched(8000, 1.5, character)("signal").alias("y"))
        return made.select("vec_id", F.size("y").alias("samples"), F.round(F.array_max(F.transform("y", F.abs)), 4).alias("peak"))

    run.__name__ = f"stretch_{name}"
    _query()(run)


for _name, _character in (("wsola", "clean"), ("vocoder", "transient"), ("granular", "scatter"), ("repeat", "stutter"), ("freeze", "frozen"), ("smear", "spectral"), ("cyclic", "cyclic"), ("varispeed", "tape")):
    _stretch_query(_name, _character)


# 289
@_query()
def pitch_shift(spark, sf_dir):
    from sonarframe.functions import udf

    made = _tones(spark, sf_dir).select("vec_id", udf.pitched(8000, 5.0, "clean")("signal").alias("y"))
    return made.select("vec_id", F.size("y").alias("samples"))


# 291 to 301
@_query()
def output_stages(spark, sf_dir):
    from sonarframe.functions import udf
    from sonarframe.kernels import stages

    rows = _tones(spark, sf_dir, 16)
    columns = [F.round(F.array_max(F.transform(udf.staged(8000, m, 100, 100, 7)("signal"), F.abs)), 4).alias(m) for m in stages.STAGES]
    return rows.select("vec_id", *columns)


# 348 to 351 and the registered primitives
@_query()
def primitive_bank(spark, sf_dir):
    from sonarframe.functions import udf
    from sonarframe.kernels import primitives

    columns = [F.round(F.array_max(F.transform(udf.primitive(k, 8000)("signal"), F.abs)), 4).alias(k) for k in primitives.keys()]
    return _tones(spark, sf_dir, 16).select("vec_id", *columns)


def _octave_sql(b: str, target: str = "126") -> str:
    """Twice or half of a tempo if that's nearer to the target by more than 0.15 octaves, else null."""
    far = lambda x: f"abs(log2(({x}) / {target}))"
    return f"CASE WHEN {far(f'{b} * 2')} < (CASE WHEN {far(f'{b} / 2')} < {far(b)} - 0.15 THEN {far(f'{b} / 2')} ELSE {far(b)} END) - 0.15 THEN {b} * 2 WHEN {far(f'{b} / 2')} < {far(b)} - 0.15 THEN {b} / 2 END"


# 200 to 216
@_query(f"""WITH p AS (SELECT p_partkey, 60.0::DOUBLE + 2 * p_size AS b, p_size % 7 = 0 AS man, p_retailprice / 100 AS d, p_size % 12 AS s, p_size % 2 = 0 AS minor, p_size % 5 = 0 AS one, p_size % 3 <> 0 AS tf, p_size % 4 <> 0 AS pf, p_size % 6 = 0 AS tape FROM part),
o AS (SELECT *, coalesce(CASE WHEN NOT man THEN {_octave_sql("b")} END, b) AS bpm FROM p), x AS (SELECT *, d * bpm / 60 AS beats, floor(d * bpm / 60 + 0.5) AS near FROM o),
t AS (SELECT *, [1.0::DOUBLE,2,4,8,16,32,64,128,256,512,1024] AS t1, [4.0::DOUBLE,8,12,16,20,24,28,32,40,48,56,64,80,96,112,128,160,192,256] AS t2, CASE WHEN near % 2 = 0 THEN [near] ELSE list_filter([near - 1, near + 1], lambda v: v >= 1) END AS t3, [near] AS t4 FROM x),
y AS (SELECT *, list_transform([t1, t2, t3, t4], lambda l: l[list_position(list_transform(l, lambda c: abs(c - beats)), list_min(list_transform(l, lambda c: abs(c - beats))))]) AS best FROM t),
w AS (SELECT *, coalesce(CASE WHEN beats >= 0.5 THEN list_filter(best, lambda c: c >= 1 AND abs(c * 60 / d / bpm - 1) <= 0.025)[1] * 60 / d END, bpm) AS src FROM y),
r AS (SELECT *, src / 126 AS raw, greatest(0.05, least(8, src / 126)) AS ratio, {_octave_sql("src")} AS hint FROM w),
e AS (SELECT *, CASE WHEN one THEN 'not applicable to this input type' WHEN NOT tf THEN 'tempo fitting off' WHEN abs(ratio - 1) <= 1e-6 THEN 'already at the target tempo' END AS reason FROM r),
k AS (SELECT *, reason IS NULL AS applied, CASE WHEN tape AND reason IS NULL THEN 12 * log2(1 / ratio) ELSE 0 END AS drift, (CASE WHEN minor THEN 4 ELSE 7 END - s + 12) % 12 AS up FROM e), q AS (SELECT *, CASE WHEN up > 6 THEN up - 12 ELSE up END AS semis FROM k),
z AS (SELECT *, greatest(-24, least(24, semis - drift)) AS stage FROM q)
SELECT p_partkey, round(CASE WHEN applied THEN ratio ELSE 1 END, 6) AS ratio, reason, applied, round(CASE WHEN pf THEN stage ELSE 0 END, 6) AS semitones, CASE WHEN NOT pf THEN 'pitch fitting off' WHEN abs(semis) <= 1e-6 AND abs(stage) <= 1e-6 THEN 'already in the target key' END AS pitch_reason, applied OR (pf AND abs(stage) > 1e-6) AS changes_audio,
array_to_string(list_filter([CASE WHEN applied AND hint IS NOT NULL THEN 'octave-suggestion' END, CASE WHEN applied AND (raw < 0.5 OR raw > 2) THEN 'extreme-stretch' END, CASE WHEN applied AND abs(ratio - raw) > 1e-6 THEN 'ratio-clamped' END, CASE WHEN NOT pf AND abs(drift) > 0.01 THEN 'method-pitch-drift' END, CASE WHEN pf AND abs(semis - drift) > 24 THEN 'pitch-clamped' END], lambda v: v IS NOT NULL), ',') AS warnings FROM z""")
def conform_plan(spark, sf_dir):
    from sonarframe.plans import conform

    size = F.col("p_size")
    loops = _table(spark, sf_dir, "part").select(
        "p_partkey", (60.0 + size * 2).alias("bpm"), (size % 7 == 0).alias("bpm_manual"), (F.col("p_retailprice") / 100).alias("duration"), music.note_name(size).alias("key"), F.when(size % 2 == 0, "minor").otherwise("major").alias("mode"),
        F.when(size % 5 == 0, "oneshot").otherwise("loop").alias("role"), (size % 3 != 0).alias("tempo_fit"), (size % 4 != 0).alias("pitch_fit"), F.when(size % 6 == 0, "tape").otherwise("inherit").alias("method"),
    )
    p = conform.plan(loops, 126.0, "E", "minor").select("p_partkey", "plan.*")
    return p.select("p_partkey", F.round("tempo.ratio", 6).alias("ratio"), "tempo.reason", "tempo.applied", F.round("pitch.semitones", 6).alias("semitones"), F.col("pitch.reason").alias("pitch_reason"), "changes_audio", F.array_join("warnings", ",").alias("warnings"))


# 303 to 311, 323 to 330 and the remix operations
@_query()
def remix_recipes(spark, sf_dir):
    from sonarframe.plans import remix

    def make(seed):
        return seed.map(lambda s: remix.pattern(remix.generate(remix.Grid(64, 4, 16), int(s), list(remix.STYLES)[s % len(remix.STYLES)])))

    return _spread(_table(spark, sf_dir, "part").select("p_partkey"), _SEEDS).select("p_partkey", F.pandas_udf(make, "string")("p_partkey").alias("pattern"))


# 343 to 347
@_query()
def signal_graphs(spark, sf_dir):
    from sonarframe.kernels import primitives

    def make(seed):
        return seed.map(lambda s: "; ".join(primitives.describe_graph(primitives.build_graph(int(s)))))

    return _spread(_table(spark, sf_dir, "part").select("p_partkey"), _SEEDS).select("p_partkey", F.pandas_udf(make, "string")("p_partkey").alias("graph"))


# 331 to 342
@_query()
def fx_bank(spark, sf_dir):
    import json

    import numpy as np

    from sonarframe.kernels import analysis
    from sonarframe.plans import fx

    def make(signals):
        def one(x):
            x = np.asarray(x, dtype=np.float32)
            found = analysis.analyse_break(x, 8000, 120.0)
            return json.dumps([fx.words(r) for r in fx.plan_bank(fx.pools(found, x, 8000), found["grid"]["beat"], 8, 0.5)])

        return signals.map(one)

    return _tones(spark, sf_dir, 256).select("vec_id", F.pandas_udf(make, "string")("signal").alias("bank"))


from sonarframe import series_queries  # noqa: E402,F401  (registers its queries here)
