"""Queries of the ordered, iterative and file operators, with their SQL.

As in ``queries``, signals come from event data; the comment at each query says which rows
of the operator inventory it covers.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from sonarframe import work
from sonarframe.functions import levels
from sonarframe.operators import aggregates, chunks, draws, frames, grids, history, matching, phrases, recurrence, selection, spectrum
from sonarframe.queries import _CURVE, _DB, _E, _HT, _PEAKS, _SESSION, _V, _events, _hourly, _query, _sessions, _signal, _table, r6
from sonarframe.sources import archive, pcm

_BEGIN = 1704067200  # 2024-01-01
_FIRST_HOUR = _BEGIN // 3600


# 1, 10, 11, 14, 17, 22: written by the data source, read back in ranges of 2 KB
@_query("SELECT event_type || '.wav' AS name, count(*) AS frames, CAST(sum(floor(least(1, floor(value) / 512) * 32767 + 0.5)) AS BIGINT) AS total, CAST(max(floor(least(1, floor(value) / 512) * 32767 + 0.5)) AS BIGINT) AS top FROM events GROUP BY 1")
def pcm_ranges(spark, sf_dir):
    rows = _events(spark, sf_dir).withColumn("path", F.concat("event_type", F.lit(".wav"))).withColumn("x", F.least(F.lit(1.0), F.floor("value") / 512).cast("float"))
    rows = chunks.running_sum(rows.select("path", "t", "event_id", "x"), ["path"], ["t", "event_id"], F.lit(1).cast("long"), "i", 1 << 12)
    blocks = rows.groupBy("path", (F.floor(F.col("i") / 64) * 64).alias("start")).agg(F.array(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s.x)).alias("samples"))
    root = work.new_path(spark, "recordings")
    pcm.write(blocks, root, 8000, 16)
    found = pcm.read(spark, root, "path string, frames int, samples array<array<float>>", 256, 2048)
    ints = F.transform(F.get("samples", F.lit(0)), lambda v: F.round(v * 32768).cast("long"))
    return found.groupBy(F.substring_index("path", "/", -1).alias("name")).agg(F.sum("frames").alias("frames"), F.sum(F.aggregate(ints, F.lit(0).cast("long"), lambda a, v: a + v)).alias("total"), F.max(F.array_max(ints)).alias("top"))


_N = "n AS (SELECT event_type, h, x, row_number() OVER (PARTITION BY event_type ORDER BY h) AS i FROM s)"


# 247, 252, 253, 295, 296
@_query(f"""WITH RECURSIVE {_HT}, {_N}, r AS (SELECT event_type, h, x, i, 0.2371::DOUBLE * x AS y FROM n WHERE i = 1 UNION ALL SELECT n.event_type, n.h, n.x, n.i, r.y + 0.2371::DOUBLE * (n.x - r.y) FROM r JOIN n ON n.event_type = r.event_type AND n.i = r.i + 1)
SELECT event_type, h, round(y, 6) AS low, round(x - y, 6) AS high FROM r""")
def smoothed_series(spark, sf_dir):
    rows = _hourly(spark, sf_dir, "event_type")
    low = recurrence.difference(rows, ["event_type"], ["h"], "x", (0.2371,), (-0.7629,), "low", 64)
    both = recurrence.difference(low, ["event_type"], ["h"], "x", (0.7629, -0.7629), (-0.7629,), "high", 64)
    return both.select("event_type", "h", r6("low").alias("low"), r6("high").alias("high"))


_EQ_B, _EQ_A = recurrence.peak_eq(24.0, 2.0, 0.8, 6.0)


# 297, 298
@_query(f"""WITH RECURSIVE {_HT}, {_N}, r AS (SELECT event_type, h, i, x AS x1, 0.0::DOUBLE AS x2, {_EQ_B[0]!r}::DOUBLE * x AS y1, 0.0::DOUBLE AS y2 FROM n WHERE i = 1 UNION ALL
SELECT n.event_type, n.h, n.i, n.x, r.x1, {_EQ_B[0]!r}::DOUBLE * n.x + ({_EQ_B[1]!r}::DOUBLE) * r.x1 + ({_EQ_B[2]!r}::DOUBLE) * r.x2 - ({_EQ_A[0]!r}::DOUBLE) * r.y1 - ({_EQ_A[1]!r}::DOUBLE) * r.y2, r.y1 FROM r JOIN n ON n.event_type = r.event_type AND n.i = r.i + 1)
SELECT event_type, h, round(y1, 6) AS y FROM r""")
def equalised_series(spark, sf_dir):
    rows = _hourly(spark, sf_dir, "event_type")
    return recurrence.difference(rows, ["event_type"], ["h"], "x", _EQ_B, _EQ_A, "y", 64).select("event_type", "h", r6("y").alias("y"))


# 247: decaying peaks
@_query(f"""WITH RECURSIVE {_HT}, {_N}, r AS (SELECT event_type, h, i, x AS p FROM n WHERE i = 1 UNION ALL SELECT n.event_type, n.h, n.i, greatest(n.x, r.p * 0.9137::DOUBLE) FROM r JOIN n ON n.event_type = r.event_type AND n.i = r.i + 1) SELECT event_type, h, round(p, 6) AS peak FROM r""")
def decaying_peaks(spark, sf_dir):
    return recurrence.peak_hold(_hourly(spark, sf_dir, "event_type"), ["event_type"], ["h"], "x", 0.9137, "peak", 64).select("event_type", "h", r6("peak").alias("peak"))


# 87, 90, 274
@_query(f"""WITH m AS (SELECT vec_id, {_V} AS e FROM embeddings), f AS (SELECT vec_id, f, e[f * 16 + 1 : f * 16 + 32] AS s FROM m, range(3) AS t(f)),
p AS (SELECT vec_id, f, k, pow(sum(s[i + 1] * cos(2 * pi() * ((k * i) % 32) / 32)), 2) + pow(sum(s[i + 1] * sin(2 * pi() * ((k * i) % 32) / 32)), 2) AS p FROM f, range(17) AS b(k), range(32) AS n(i) GROUP BY ALL)
SELECT vec_id, f AS frame, round(exp(avg(ln(p + 1e-12::DOUBLE))) / avg(p + 1e-12::DOUBLE), 6) AS flatness, round(sum(p) FILTER (k < 4) / sum(p), 6) AS low, round(sum(p) FILTER (k >= 4) / sum(p), 6) AS high FROM p GROUP BY vec_id, f""")
def spectra(spark, sf_dir):
    rows = _table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(_signal()).alias("i", "v"))
    found = spectrum.powers(spectrum.framed(rows, ["vec_id"], "i", "v", 32, 16), "samples", 32)
    shares = spectrum.band_shares("powers", [0, 4, 17])
    return found.select("vec_id", "frame", r6(spectrum.flatness("powers")).alias("flatness"), r6(F.get(shares, F.lit(0))).alias("low"), r6(F.get(shares, F.lit(1))).alias("high"))


# 75, 146: first-come leaders of similar vectors, the loudest of each cluster
@_query(f"""WITH RECURSIVE m AS (SELECT label, vec_id, {_V} AS e FROM embeddings), b AS (SELECT label, vec_id, sqrt(list_sum(list_transform(e, lambda v: v * v))) AS peak, list_transform(range(5), lambda k: log10(sqrt(list_sum(list_transform(e[k * 13 + 1 : k * 13 + 13], lambda v: v * v)) / len(e[k * 13 + 1 : k * 13 + 13])) + 1e-6::DOUBLE)) AS raw FROM m),
c AS (SELECT label, vec_id, peak, list_transform(raw, lambda v: v - list_avg(raw)) AS c FROM b), v AS (SELECT label, vec_id, peak, list_transform(c, lambda x: x / CASE WHEN sqrt(list_sum(list_transform(c, lambda y: y * y))) = 0 THEN 1 ELSE sqrt(list_sum(list_transform(c, lambda y: y * y))) END) AS v FROM c),
l AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS i FROM (SELECT *, max(peak) OVER (PARTITION BY label) AS top FROM v) WHERE peak >= top * 0.08::DOUBLE),
r AS (SELECT label, i, vec_id, peak, vec_id AS leader, [{{'id': vec_id, 'v': v}}] AS found FROM l WHERE i = 1 UNION ALL
SELECT l.label, l.i, l.vec_id, l.peak, coalesce(list_filter(r.found, lambda f: 1 - list_inner_product(f.v, l.v) <= 0.06::DOUBLE)[1].id, l.vec_id), CASE WHEN len(list_filter(r.found, lambda f: 1 - list_inner_product(f.v, l.v) <= 0.06::DOUBLE)) > 0 THEN r.found ELSE list_append(r.found, {{'id': l.vec_id, 'v': l.v}}) END FROM r JOIN l ON l.label = r.label AND l.i = r.i + 1),
best AS (SELECT label, leader, vec_id, peak FROM r QUALIFY row_number() OVER (PARTITION BY label, leader ORDER BY peak DESC, vec_id) = 1)
SELECT label, vec_id, round(peak, 6) AS peak FROM best QUALIFY row_number() OVER (PARTITION BY label ORDER BY peak DESC, leader) <= 24""")
def similar_hits(spark, sf_dir):
    x = _signal()
    band = lambda k: F.slice(x, k * 13 + 1, 13)
    squares = lambda a: F.aggregate(a, F.lit(0.0), lambda s, v: s + v * v)
    raw = F.array(*(F.log10(F.sqrt(squares(band(k)) / F.size(band(k))) + 1e-6) for k in range(5)))
    rows = _table(spark, sf_dir, "embeddings").select("label", "vec_id", F.sqrt(squares(x)).alias("peak"), raw.alias("raw")).select("label", "vec_id", "peak", aggregates.fingerprint("raw").alias("fingerprint"))
    return selection.dedupe(rows, ["label"], "vec_id", "fingerprint", "peak").select("label", "vec_id", r6("peak").alias("peak"))


_SCORED = f"""{_HT}, {_CURVE}, {_PEAKS}, d AS (SELECT event_type, h, {_DB} AS db FROM s), g AS (SELECT event_type, h, db, coalesce(avg(CASE WHEN db > -180 THEN db END) OVER (PARTITION BY event_type ORDER BY h ROWS BETWEEN 11 PRECEDING AND CURRENT ROW), -180) AS ref FROM d),
u AS (SELECT *, max(CASE WHEN db > ref - 3 THEN h END) OVER w AS up, min(h) OVER w - 1 AS first FROM g WINDOW w AS (PARTITION BY event_type ORDER BY h)), f AS (SELECT *, h - coalesce(up, first) AS down FROM u),
q2 AS (SELECT event_type, strength, row_number() OVER (PARTITION BY event_type ORDER BY strength) - 1 AS r, count(*) OVER (PARTITION BY event_type) AS n FROM peaks), y AS (SELECT event_type, greatest(1e-6::DOUBLE, strength) AS typical FROM q2 WHERE r = CAST(floor((n - 1) * 0.75) AS BIGINT)),
b AS (SELECT o.event_type, o.h, o.strength, min(f.db) FILTER (f.h < o.h) AS low, max(least(f.down, f.h - (o.h - 8) + 1)) FILTER (f.h < o.h) AS run, max(f.ref) FILTER (f.h = o.h) AS here FROM peaks o JOIN f ON f.event_type = o.event_type AND f.h BETWEEN o.h - 8 AND o.h GROUP BY ALL),
z AS (SELECT b.event_type, b.h, CASE WHEN low IS NULL THEN 0 ELSE greatest(0, here - low) / 3.0::DOUBLE + least(2, strength / typical) + run / 2.0::DOUBLE END AS score FROM b JOIN y USING (event_type))"""


# 48, 114, 115: scored boundaries, best first with spacing
@_query(f"""WITH RECURSIVE {_SCORED},
k AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY round(score, 9) DESC, h) AS i FROM z),
t AS (SELECT event_type, i, h, score, [h] AS cuts, true AS taken FROM k WHERE i = 1 UNION ALL SELECT k.event_type, k.i, k.h, k.score, CASE WHEN len(list_filter(t.cuts, lambda c: abs(c - k.h) < 24)) = 0 THEN list_append(t.cuts, k.h) ELSE t.cuts END, len(list_filter(t.cuts, lambda c: abs(c - k.h) < 24)) = 0 FROM t JOIN k ON k.event_type = t.event_type AND k.i = t.i + 1)
SELECT event_type, h, round(score, 6) AS score FROM t WHERE taken""")
def spaced_cuts(spark, sf_dir):
    rows = _hourly(spark, sf_dir, "event_type").withColumn("db", levels.to_db("x"))
    peaks = frames.onset_peaks(frames.onset_curve(rows, ["event_type"], "h", "x"), ["event_type"], "h", "strength").select("event_type", "h", "strength")
    scored = selection.boundary_scores(rows.select("event_type", "h", "db"), peaks, ["event_type"], "h", "db", "strength", back=8, deep=3.0, long=2, reference=12)
    cuts = selection.spaced(scored.withColumn("rank", F.round("score", 9)), ["event_type"], "h", "rank", 24.0)
    return cuts.select("event_type", "h", r6("score").alias("score"))


# 36, 48, 114, 115: runs of playing, cut at the best boundaries; forced cuts are tested beside (no run is over the limit here)
@_query(f"""WITH RECURSIVE {_SCORED}, lv AS (SELECT event_type, db, row_number() OVER (PARTITION BY event_type ORDER BY db) - 1 AS r, count(*) OVER (PARTITION BY event_type) AS n FROM d WHERE db > -180), gt AS (SELECT event_type, db AS loud FROM lv WHERE r = CAST(floor((n - 1) * 0.9) AS BIGINT)),
l1 AS (SELECT event_type, h, db >= loud - 6 AS loud FROM d JOIN gt USING (event_type)), a1 AS (SELECT *, CASE WHEN loud = lag(loud) OVER w THEN 0 ELSE 1 END AS new FROM l1 WINDOW w AS (PARTITION BY event_type ORDER BY h)), b1 AS (SELECT *, sum(new) OVER (PARTITION BY event_type ORDER BY h) AS run FROM a1),
c1 AS (SELECT event_type, run, loud OR count(*) < 3 AS inside, min(h) AS f, max(h) AS t FROM b1 GROUP BY event_type, run, loud), d1 AS (SELECT *, coalesce(lead(f) OVER w, t + 1) AS e, CASE WHEN inside = lag(inside) OVER w THEN 0 ELSE 1 END AS new FROM c1 WINDOW w AS (PARTITION BY event_type ORDER BY run)),
i1 AS (SELECT *, sum(new) OVER (PARTITION BY event_type ORDER BY run) AS isle FROM d1), runs AS (SELECT event_type, min(f) AS a, max(e) AS z FROM i1 WHERE inside GROUP BY event_type, isle),
cand AS (SELECT zz.event_type, zz.h, score FROM z zz JOIN runs USING (event_type) WHERE z - a >= 9 AND zz.h > a + 5 AND zz.h < z - 5 AND score >= 0.5),
k AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY score DESC, h) AS i FROM cand),
t AS (SELECT event_type, i, h, [h] AS cuts, true AS taken FROM k WHERE i = 1 UNION ALL SELECT k.event_type, k.i, k.h, CASE WHEN len(list_filter(t.cuts, lambda c: abs(c - k.h) < 5)) = 0 THEN list_append(t.cuts, k.h) ELSE t.cuts END, len(list_filter(t.cuts, lambda c: abs(c - k.h) < 5)) = 0 FROM t JOIN k ON k.event_type = t.event_type AND k.i = t.i + 1),
mk AS (SELECT event_type, a AS s, z FROM runs UNION ALL SELECT t.event_type, t.h, r.z FROM t JOIN runs r ON r.event_type = t.event_type AND t.h > r.a AND t.h < r.z WHERE taken)
SELECT event_type, CAST(s AS DOUBLE) AS "start", CAST(least(z, coalesce(lead(s) OVER (PARTITION BY event_type ORDER BY s), z)) AS DOUBLE) AS "end" FROM mk""")
def phrase_regions(spark, sf_dir):
    rows = _hourly(spark, sf_dir, "event_type").withColumn("db", levels.to_db("x"))
    peaks = frames.onset_peaks(frames.onset_curve(rows, ["event_type"], "h", "x"), ["event_type"], "h", "strength").select("event_type", "h", "strength")
    return phrases.regions(rows.select("event_type", "h", "db"), peaks, ["event_type"], "h", "db", "strength", rest=3, shortest=6.0, longest=1000.0, preferred=500.0, spacing=5.0, back=8, deep=3.0, long=2, reference=12, drop=6.0, boundary=0.5)


_ON = f"on0 AS (SELECT event_type AS k, floor((t - {_BEGIN}) / 1800 + 0.5) / 2 + ((event_id * 37) % 41 - 20) * 0.0001::DOUBLE AS t, value AS v FROM e WHERE value > 0), tot AS (SELECT k, count(*) AS n, max(v) AS top FROM on0 GROUP BY k), o AS (SELECT on0.* , top FROM on0 JOIN tot USING (k) WHERE n >= 8)"


def _scan_sql(name: str, centre: str, reach: str, steps: int) -> str:
    """The best of a scan around ``centre`` (a relation with k, c)."""
    return f"""{name}_s AS (SELECT o.k, i, c.c + ({reach}) * (i / {steps}.0::DOUBLE) AS beat, sum(v) AS total, sum(v * cos(2 * pi() / ((c.c + ({reach}) * (i / {steps}.0::DOUBLE)) / 2) * t)) AS re, sum(v * sin(2 * pi() / ((c.c + ({reach}) * (i / {steps}.0::DOUBLE)) / 2) * t)) AS im FROM o JOIN {centre} c USING (k), range(-{steps}, {steps} + 1) AS x(i) GROUP BY o.k, i, c.c),
{name} AS (SELECT k, beat, sqrt(re * re + im * im) / total AS coherence, atan2(im, re) / (2 * pi()) * (beat / 2) - (beat / 2) * floor(atan2(im, re) / (2 * pi())) AS phase FROM {name}_s QUALIFY row_number() OVER (PARTITION BY k ORDER BY sqrt(re * re + im * im) / total DESC, i) = 1)"""


def _pass_sql(n: int, before: str, reach: float) -> str:
    near = f"""n{n} AS (SELECT o.k, floor((t - phase) / beat + 0.5) AS j, min_by(t, struct_pack(a := -v, b := t)) AS t FROM o JOIN {before} g USING (k) WHERE abs(t - (phase + beat * floor((t - phase) / beat + 0.5))) <= least({reach}::DOUBLE, beat / 6) GROUP BY ALL)"""
    return f"""{near}, a{n} AS (SELECT k, regr_slope(t, j) AS s, regr_intercept(t, j) AS b FROM n{n} GROUP BY k HAVING count(*) >= 8 AND regr_slope(t, j) IS NOT NULL),
l{n} AS (SELECT k, regr_slope(t, j) AS s, regr_intercept(t, j) AS b, count(*) AS c FROM n{n} JOIN a{n} USING (k) WHERE abs(t - (a{n}.b + a{n}.s * j)) <= 0.008::DOUBLE GROUP BY k HAVING count(*) >= 8),
g{n} AS (SELECT g.k, CASE WHEN abs(l.s / 1.003::DOUBLE - 1) <= 0.015::DOUBLE THEN l.s ELSE beat END AS beat, CASE WHEN abs(l.s / 1.003::DOUBLE - 1) <= 0.015::DOUBLE THEN l.b ELSE phase END AS phase, coherence, CASE WHEN abs(l.s / 1.003::DOUBLE - 1) <= 0.015::DOUBLE THEN l.c ELSE points END AS points FROM {before} g LEFT JOIN l{n} l USING (k))"""


# 118, 119: events near half hours of a beat of an hour, with a few seconds of jitter
@_query(f"""WITH {_E}, {_ON}, est AS (SELECT k, 1.003::DOUBLE AS c FROM tot WHERE n >= 8), {_scan_sql("co", "est", "1.003::DOUBLE * 0.01::DOUBLE", 20)}, fc AS (SELECT k, beat AS c FROM co), {_scan_sql("fi", "fc", "1.003::DOUBLE * (0.01::DOUBLE / 20)", 20)},
w AS (SELECT o.k, beat, phase, coherence, atan2(sum(v * sin(2 * pi() / beat * t)), sum(v * cos(2 * pi() / beat * t))) / (2 * pi()) * beat AS pt FROM o JOIN fi USING (k) WHERE coherence >= 0.15 GROUP BY o.k, beat, phase, coherence),
far AS (SELECT *, abs((phase - pt + beat / 2) - beat * floor((phase - pt + beat / 2) / beat) - beat / 2) AS d0, abs((phase + beat / 2 - pt + beat / 2) - beat * floor((phase + beat / 2 - pt + beat / 2) / beat) - beat / 2) AS d1 FROM w),
g0 AS (SELECT k, beat, CASE WHEN d0 <= d1 THEN phase ELSE phase + beat / 2 END - beat * floor(CASE WHEN d0 <= d1 THEN phase ELSE phase + beat / 2 END / beat) AS phase, coherence, 0 AS points FROM far), {_pass_sql(1, "g0", 0.04)}, {_pass_sql(2, "g1", 0.015)},
s3 AS (SELECT o.k, floor((t - phase) / beat + 0.5) AS j, min_by(struct_pack(t := t, v := v, top := top), struct_pack(a := -v, b := t)) AS m FROM o JOIN g2 USING (k) WHERE abs(t - (phase + beat * floor((t - phase) / beat + 0.5))) <= least(0.015::DOUBLE, beat / 6) GROUP BY ALL),
r3 AS (SELECT s3.k, m.t - (phase + beat * j) AS away FROM s3 JOIN g2 USING (k) WHERE m.v >= m.top * 0.35::DOUBLE), q3 AS (SELECT k, away, row_number() OVER (PARTITION BY k ORDER BY away) - 1 AS r, count(*) OVER (PARTITION BY k) AS n FROM r3), sh AS (SELECT k, away FROM q3 WHERE n >= 4 AND r = CAST(floor(n * 0.25) AS BIGINT)),
mv AS (SELECT g2.*, phase + CASE WHEN abs(away) <= 0.02 THEN away ELSE 0 END AS moved FROM g2 LEFT JOIN sh USING (k))
SELECT k AS event_type, round(beat, 6) AS beat, round(moved - beat * floor(moved / beat), 5) AS phase, round(coherence, 5) AS coherence, CAST(points AS BIGINT) AS points FROM mv""")
def beat_fit(spark, sf_dir):
    jitter = ((F.col("event_id") * 37) % 41 - 20) * 0.0001
    rows = _events(spark, sf_dir).select("event_type", (F.floor((F.col("t") - _BEGIN) / 1800 + 0.5) / 2 + jitter).alias("at"), "value", F.lit(1.003).alias("estimate"))
    return grids.fit(rows, ["event_type"], "at", "value", "estimate").select("event_type", r6("beat").alias("beat"), F.round("phase", 5).alias("phase"), F.round("coherence", 5).alias("coherence"), "points")


def _fold_sql(period: float) -> str:
    steps = int(period + 0.5)
    return f"""SELECT event_type, {period} AS period, round(CASE WHEN s * ({period} / {steps}.0::DOUBLE) > {period} / 2 THEN s * ({period} / {steps}.0::DOUBLE) - {period} ELSE s * ({period} / {steps}.0::DOUBLE) END, 6) AS "offset", round(score / mean, 6) AS confidence FROM (
SELECT event_type, s, score, sum(score) OVER (PARTITION BY event_type) / {steps} AS mean, row_number() OVER (PARTITION BY event_type ORDER BY round(score, 9) DESC, s) AS r FROM (
SELECT z.event_type, q % {steps} AS s, sum(coalesce(a.f, 0) * (1 - (pos - floor(pos))) + coalesce(b.f, 0) * (pos - floor(pos))) AS score FROM (SELECT event_type, n, q, q * ({period} / {steps}.0::DOUBLE) AS pos FROM z, range(2000) AS x(q) WHERE q < floor(n / {period}) * {steps} AND n >= 2 * {period}) z
LEFT JOIN f a ON a.event_type = z.event_type AND a.i = CAST(floor(pos) AS BIGINT) % n LEFT JOIN f b ON b.event_type = z.event_type AND b.i = (CAST(floor(pos) AS BIGINT) + 1) % n GROUP BY ALL)) WHERE r = 1"""


# 127, 128
@_query(f"""WITH {_HT}, f AS (SELECT event_type, h - {_FIRST_HOUR} AS i, greatest(0, coalesce(x - lag(x) OVER (PARTITION BY event_type ORDER BY h), 0)) AS f FROM s), z AS (SELECT event_type, max(i) + 1 AS n FROM f GROUP BY event_type HAVING sum(f) > 0) {_fold_sql(24.0)} UNION ALL {_fold_sql(10.5)}""")
def folded_phase(spark, sf_dir):
    flux = frames.peak_normalised_flux(_hourly(spark, sf_dir, "event_type"), ["event_type"], "h", "x", "share")
    top = flux.groupBy("event_type").agg(F.max("share").alias("m"))  # the flux is what the SQL has, but for its scale
    rows = flux.join(top, "event_type").select("event_type", (F.col("h") - _FIRST_HOUR).alias("i"), F.col("share").alias("f"))
    found = [grids.fold(rows, ["event_type"], "i", "f", p).select("event_type", F.lit(p).alias("period"), r6("offset").alias("offset"), r6("confidence").alias("confidence")) for p in (24.0, 10.5)]
    return found[0].unionByName(found[1])


# 57 to 62
@_query(f"""WITH RECURSIVE {_E}, a AS (SELECT user_id, event_id, CASE WHEN event_type IN ('click', 'purchase', 'signup') THEN 'commit' WHEN event_type = 'view' THEN 'undo' ELSE 'redo' END AS act, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) AS i FROM e),
r AS (SELECT user_id, 0::BIGINT AS i, NULL::BIGINT AS event_id, []::BIGINT[] AS vs, 0::BIGINT AS cur FROM (SELECT DISTINCT user_id FROM a) UNION ALL
SELECT a.user_id, a.i, a.event_id, CASE WHEN act = 'commit' THEN list_append(r.vs[1 : r.cur], a.event_id)[-5 :] ELSE r.vs END, CASE WHEN act = 'commit' THEN least(5, r.cur + 1) WHEN act = 'undo' THEN CASE WHEN r.cur > 1 THEN r.cur - 1 ELSE r.cur END ELSE CASE WHEN r.cur < len(r.vs) THEN r.cur + 1 ELSE r.cur END END FROM r JOIN a ON a.user_id = r.user_id AND a.i = r.i + 1)
SELECT user_id, event_id, vs[cur] AS current, cur > 1 AS can_undo, cur < len(vs) AS can_redo FROM r WHERE i > 0""")
def edit_replay(spark, sf_dir):
    act = F.when(F.col("event_type").isin("click", "purchase", "signup"), history.COMMIT).when(F.col("event_type") == "view", history.UNDO).otherwise(history.REDO)
    rows = _events(spark, sf_dir).select("user_id", "t", "event_id", act.alias("act"))
    return history.replay(rows, ["user_id"], ["t", "event_id"], "act", "event_id", 5).select("user_id", "event_id", "current", "can_undo", "can_redo")


def _u(salt: str, *parts: str) -> str:
    return f"(CAST('0x' || substr(md5(concat_ws('|', '{salt}', {', '.join(f'CAST({p} AS VARCHAR)' for p in parts)})), 1, 13) AS BIGINT) / {1 << 52}.0::DOUBLE)"


# 149 to 151, 148
@_query(f"""WITH d AS (SELECT l_suppkey, l_orderkey, l_linenumber, -ln(1 - {_u("pick", "7", "l_suppkey", "l_orderkey", "l_linenumber")}) / CAST(l_quantity AS DOUBLE) AS w FROM lineitem WHERE l_quantity > 0) SELECT l_suppkey, CAST(draw AS INTEGER) AS draw, l_orderkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY w, l_orderkey, l_linenumber) AS draw FROM d) WHERE draw <= 3""")
def weighted_draws(spark, sf_dir):
    rows = _table(spark, sf_dir, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_quantity")
    return draws.sample(rows, ["l_suppkey"], "l_quantity", ["l_orderkey", "l_linenumber"], 3, 7).select("l_suppkey", "draw", "l_orderkey", "l_linenumber")


# 153, 154
@_query(f"""SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY {_u("shuffle", "11", "o_custkey", "o_orderkey")}, o_orderkey) - 1 AS place, CASE WHEN {_u("", "3", "o_orderkey")} * 10 < 1 THEN 'soft' WHEN {_u("", "3", "o_orderkey")} * 10 < 5 THEN 'plain' ELSE 'wild' END AS style FROM orders""")
def seeded_order(spark, sf_dir):
    rows = _table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", draws.choose(3, ["o_orderkey"], ["soft", "plain", "wild"], [1, 4, 5]).alias("style"))
    return draws.shuffled(rows, ["o_custkey"], ["o_orderkey"], 11, 1 << 10).select("o_custkey", "o_orderkey", "place", "style")


# 20: where each entry stands in an archive of stored files
@_query("""WITH f AS (SELECT 'status ' || o_orderstatus AS folder, CAST(o_orderkey AS VARCHAR) || '.txt' AS name, repeat('x', CAST(o_custkey % 97 AS INTEGER)) AS content FROM orders) SELECT folder, name, CAST(length(content) AS BIGINT) AS packed, CAST(coalesce(sum(50 + length(name) + length(content)) OVER (PARTITION BY folder ORDER BY name ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset" FROM f""")
def archive_offsets(spark, sf_dir):
    files = _table(spark, sf_dir, "orders").select(F.concat(F.lit("status "), "o_orderstatus").alias("folder"), F.concat(F.col("o_orderkey").cast("string"), F.lit(".txt")).alias("name"), F.repeat(F.lit("x"), (F.col("o_custkey") % 97).cast("int")).cast("binary").alias("content"))
    return archive.entries(files, archive.STORED).select("folder", "name", "packed", "offset")


_HITS = f"hits AS (SELECT user_id AS k, (t - {_BEGIN}) / 3600 AS o, least(1, value / 100) AS p, (event_id % 10) / 10.0::DOUBLE AS s, CASE WHEN event_type IN ('click', 'signup') THEN 'snare' WHEN event_type = 'view' THEN 'kick' ELSE 'hat' END AS label, (user_id % 4) * 0.5::DOUBLE AS down, 60.0::DOUBLE + 15 * (user_id % 3) AS bpm, least(1, value / 100) * (0.5 + (event_id % 10) / 10.0::DOUBLE) AS w FROM e)"


def _hits(spark, sf_dir):
    e = _events(spark, sf_dir)
    label = F.when(F.col("event_type").isin("click", "signup"), "snare").when(F.col("event_type") == "view", "kick").otherwise("hat")
    return e.select("user_id", ((F.col("t") - _BEGIN) / 3600).alias("onset"), F.least(F.lit(1.0), F.col("value") / 100).alias("peak"), ((F.col("event_id") % 10) / 10.0).alias("strength"), label.alias("label"), F.lit(1.0).alias("beat"), ((F.col("user_id") % 4) * 0.5).alias("down"), (60.0 + 15 * (F.col("user_id") % 3)).alias("bpm"))


_GAIN = "CASE WHEN p < 0.2 THEN 0 WHEN label = 'snare' THEN CASE WHEN least(abs(pos - 1), 4 - abs(pos - 1)) <= 0.14 OR least(abs(pos - 3), 4 - abs(pos - 3)) <= 0.14 THEN w WHEN least(abs(pos), 4 - abs(pos)) <= 0.14 OR least(abs(pos - 2), 4 - abs(pos - 2)) <= 0.14 THEN -0.6 * w ELSE 0 END WHEN label = 'kick' THEN CASE WHEN least(abs(pos), 4 - abs(pos)) <= 0.14 THEN 0.5 * w WHEN least(abs(pos - 2), 4 - abs(pos - 2)) <= 0.14 THEN 0.25 * w ELSE 0 END ELSE 0 END"


# 103 to 105: half-beat shifts of the downbeat
@_query(f"""WITH RECURSIVE {_E}, {_HITS}, x AS (SELECT *, (o - (down + j / 2.0::DOUBLE)) - 4 * floor((o - (down + j / 2.0::DOUBLE)) / 4) AS pos FROM hits, range(8) AS r(j)), sc AS (SELECT k, j, min(down) + j / 2.0::DOUBLE AS d, sum({_GAIN}) AS s FROM x GROUP BY k, j), sd AS (SELECT *, least(d - 4 * floor(d / 4), 4 - (d - 4 * floor(d / 4))) AS edge FROM sc),
b AS (SELECT k, j, d, s, edge, false AS moved, s AS s0, d AS d0, edge AS e0 FROM sd WHERE j = 0 UNION ALL
SELECT b.k, sd.j, CASE WHEN sd.s > b.s + 1e-6 OR (abs(sd.s - b.s) <= 1e-6 AND b.moved AND sd.edge < b.edge) THEN sd.d ELSE b.d END, CASE WHEN sd.s > b.s + 1e-6 OR (abs(sd.s - b.s) <= 1e-6 AND b.moved AND sd.edge < b.edge) THEN sd.s ELSE b.s END, CASE WHEN sd.s > b.s + 1e-6 OR (abs(sd.s - b.s) <= 1e-6 AND b.moved AND sd.edge < b.edge) THEN sd.edge ELSE b.edge END,
b.moved OR sd.s > b.s + 1e-6, b.s0, b.d0, b.e0 FROM b JOIN sd ON sd.k = b.k AND sd.j = b.j + 1), n AS (SELECT k, count(*) FILTER (label = 'snare' AND p >= 0.2) AS n FROM hits GROUP BY k)
SELECT k AS user_id, round(CASE WHEN n >= 2 AND moved AND (s >= s0 + greatest(0.6, abs(s0) * 0.3) OR (abs(s - s0) <= 1e-6 AND edge + 0.01 < e0)) THEN d - 4 * floor(d / 4) ELSE d0 END, 6) AS downbeat FROM b JOIN n USING (k) WHERE j = 7""")
def bar_votes(spark, sf_dir):
    return grids.bar_vote(_hits(spark, sf_dir), ["user_id"], "onset", "peak", "strength", "label", "beat", "down").select("user_id", r6("downbeat").alias("downbeat"))


# 103, 104: twice or half the tempo
@_query(f"""WITH {_E}, {_HITS}, per AS (SELECT k, min(o) AS anchor, min(bpm) AS bpm, count(*) FILTER (label = 'snare' AND p >= 0.2) AS n FROM hits GROUP BY k), c AS (SELECT k, anchor, i, bpm * f AS b, 60 / (bpm * f) AS beat FROM per, (VALUES (0, 1.0::DOUBLE), (1, 2.0::DOUBLE), (2, 0.5::DOUBLE)) AS v(i, f) WHERE n >= 3 AND (i = 0 OR bpm * f BETWEEN 60 AND 220)),
x AS (SELECT c.k, c.i, c.b, c.beat, j, (o - (anchor + j * beat / 2)) / beat AS a, w FROM hits JOIN c USING (k), range(8) AS r(j) WHERE label = 'snare' AND p >= 0.2), y AS (SELECT *, floor(a / 4) AS bar, a - floor(a / 4) * 4 AS pos FROM x),
z AS (SELECT *, CASE WHEN abs(pos - 1) <= 0.14 OR abs(pos - 5) <= 0.14 THEN 1 WHEN abs(pos - 3) <= 0.14 OR abs(pos - 7) <= 0.14 THEN 3 WHEN abs(pos) <= 0.14 OR abs(pos - 4) <= 0.14 OR abs(pos - 2) <= 0.14 OR abs(pos - 6) <= 0.14 THEN 0 END AS spot FROM y),
bars AS (SELECT k, i, b, beat, j, bar, coalesce(max(w) FILTER (spot = 1), 0) AS two, coalesce(max(w) FILTER (spot = 3), 0) AS four, coalesce(sum(w) FILTER (spot = 0), 0) AS wrong FROM z GROUP BY k, i, b, beat, j, bar), turns AS (SELECT k, i, b, beat, j, sum(least(two, four)) - 0.6 * sum(wrong) AS s FROM bars GROUP BY k, i, b, beat, j),
sc AS (SELECT k, i, b, max(s) / greatest(1, 4 * beat) AS score FROM turns GROUP BY k, i, b, beat), best AS (SELECT k, arg_max(i, struct_pack(a := score, z := -i)) AS i, arg_max(b, struct_pack(a := score, z := -i)) AS b, max(score) AS score, max(score) FILTER (i = 0) AS now FROM sc GROUP BY k)
SELECT per.k AS user_id, round(CASE WHEN i <> 0 AND score > 0 AND score >= now * 1.5 + 0.05 THEN b ELSE bpm END, 6) AS bpm FROM per LEFT JOIN best USING (k)""")
def octave_votes(spark, sf_dir):
    return grids.tempo_octave(_hits(spark, sf_dir), ["user_id"], "onset", "peak", "strength", "label", "bpm").select("user_id", r6("bpm").alias("bpm"))


_HOURS = f"{_E}, n1 AS (SELECT user_id, t, CASE WHEN t - lag(t) OVER (PARTITION BY user_id ORDER BY t) < 7200 THEN 0 ELSE 1 END AS new FROM e), m1 AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY t) AS i FROM n1), small AS (SELECT user_id, i, min(t) AS \"start\", max(t) AS \"end\" FROM m1 GROUP BY user_id, i)"


# 77
@_query(f"""WITH {_SESSION}, {_HOURS.removeprefix(_E + ", ")} SELECT b.user_id, b."start" AS p_start, b."end" AS p_end, s."start" AS "start", s."end" AS "end" FROM ses b JOIN small s ON s.user_id = b.user_id AND s."start" >= b."start" AND s."end" <= b."end" """)
def inner_regions(spark, sf_dir):
    from sonarframe.operators import intervals

    small = intervals.sessions(_events(spark, sf_dir), ["user_id"], "t", 7200.0).select("user_id", "start", "end")
    return matching.children(_sessions(spark, sf_dir).select("user_id", "start", "end"), small, ["user_id"], 86400.0).select("user_id", "p_start", "p_end", "start", "end")


# 67: an analysis is taken from the cache only under the same signature
@_query("""WITH c AS (SELECT p_partkey, p_size % 5 AS signature, p_retailprice AS bpm FROM part WHERE p_partkey % 3 = 0) SELECT p.p_partkey, p.p_size % 5 AS signature, round(c.bpm, 2) AS bpm, c.bpm IS NULL AS stale FROM (SELECT p_partkey, p_size FROM part) p LEFT JOIN c ON c.p_partkey = p.p_partkey - p.p_partkey % 2 * 3 AND c.signature = p.p_size % 5""")
def cached_analysis(spark, sf_dir):
    part = _table(spark, sf_dir, "part")
    cache = part.where("p_partkey % 3 = 0").select(F.col("p_partkey").alias("file"), (F.col("p_size") % 5).alias("signature"), F.col("p_retailprice").alias("bpm"))
    asked = part.select("p_partkey", (F.col("p_partkey") - F.col("p_partkey") % 2 * 3).alias("file"), (F.col("p_size") % 5).alias("signature"))
    return matching.lookup(asked, cache, ["file"], "signature").select("p_partkey", "signature", F.round("bpm", 2).alias("bpm"), F.col("bpm").isNull().alias("stale"))
