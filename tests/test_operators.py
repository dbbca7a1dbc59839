import math

from pyspark.sql import functions as F

from sonarframe.functions import levels, music, naming, numbers, tempo
from sonarframe.operators import aggregates, inclusion, intervals, matching, slices


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_numbers(spark):
    assert one(spark, numbers.half_up(F.lit(-2.5))) == -2
    assert one(spark, numbers.modulo(F.lit(-7), F.lit(12))) == 5
    a = F.array(*(F.lit(float(i)) for i in range(1, 8)))
    assert one(spark, numbers.step_at(a, 0.82, True)) == 5.0
    assert one(spark, numbers.step_at(a, 0.10, False)) == 1.0
    assert one(spark, numbers.next_power_of_two(F.lit(1000))) == 1024


def test_levels(spark):
    assert one(spark, levels.to_db(F.lit(0.0))) == -180
    assert one(spark, levels.to_db(F.lit(0.0), levels.LOUDNESS_FLOOR_DB)) == -120
    assert one(spark, levels.match_gain(F.lit(None).cast("double"))) == 1
    assert math.isclose(one(spark, levels.match_gain(F.lit(-50.0))), 10 ** (12 / 20))
    assert one(spark, levels.ratio_to_semitones(F.lit(-1.0))) == 0


def test_music(spark):
    assert one(spark, music.note_index(F.lit(" d♭ "))) == 1
    assert one(spark, music.note_index(F.lit("H"))) is None
    assert one(spark, music.nearest_semitones(F.lit(0), F.lit(6))) == 6
    assert one(spark, music.nearest_semitones(F.lit(0), F.lit(7))) == -5
    assert one(spark, music.mode(F.lit("dorian"))) == "major"
    t = one(spark, music.transposition(F.lit("A"), F.lit("minor"), F.lit("C"), F.lit("major")))
    assert t.semitones == 0 and t.relative_used
    assert one(spark, music.degree_semitones(F.lit("minor"), F.lit(-1))) == -2


def test_tempo(spark):
    assert one(spark, tempo.better_octave(F.lit(170.0), F.lit(85.0))) == 85
    assert one(spark, tempo.better_octave(F.lit(100.0), F.lit(110.0))) is None
    snap = one(spark, tempo.loop_snap(F.lit(8.0), F.lit(119.0)))
    assert snap.bpm == 120 and snap.beats == 16
    assert one(spark, tempo.interpretations(F.lit(120.0))) == [30, 60, 80, 120, 180, 240]
    assert one(spark, tempo.effective(F.lit(None).cast("double"), F.lit(0.0))) is None
    assert one(spark, tempo.source_bpm(F.lit(None).cast("double"))) is None


def test_naming(spark):
    assert one(spark, naming.sanitize_for_path(F.lit(" a/b:  c[d] "))) == "a-b- c-d-"
    assert one(spark, naming.join_parts(F.lit("a"), F.lit(""), F.lit(None), F.lit("b"))) == "a b"
    assert one(spark, naming.key_tempo_tag(F.lit("C#"), F.lit("minor"), F.lit(119.6))) == "C#m 120bpm"
    assert one(spark, naming.resolve_pattern("{NAME}-{tag}", {"name": F.lit("{tag}"), "tag": F.lit("x")})) == "{tag}-x"
    assert naming.pattern_of(naming.segments("a{Key}b{nope}")) == "a{key}b{nope}"
    assert one(spark, naming.padded(F.lit(123))) == "123"
    assert one(spark, naming.stem_of(F.lit(".hidden"))) == ".hidden"


def regions(*pairs):
    return F.array(*(F.struct(F.lit(float(a)).alias("start"), F.lit(float(b)).alias("end")) for a, b in pairs))


def pairs(rows):
    return None if rows is None else [(r.start, r.end) for r in rows]


def test_region_arrays(spark):
    r = regions((0, 4), (6, 10))
    assert pairs(one(spark, intervals.split_at(r, F.lit(2.0), 1.0))) == [(0, 2), (2, 4), (6, 10)]
    assert one(spark, intervals.split_at(r, F.lit(3.5), 1.0)) is None
    assert pairs(one(spark, intervals.add_or_split(r, F.lit(4.5), 1.0, F.lit(12.0)))) == [(0, 4), (4.5, 6), (6, 10)]
    assert pairs(one(spark, intervals.splice(r, F.lit(7.0), F.lit(7.0), regions((7, 9))))) == [(0, 4), (6, 7), (7, 9)]
    assert pairs(one(spark, intervals.equal_slices(F.lit(0.0), F.lit(1.0), F.lit(3))))[-1][1] == 1.0
    assert one(spark, intervals.cue_frames(r, F.lit(10), F.lit(50))) == [0, 49]


def test_merge_takes_the_later_end(spark):
    df = spark.createDataFrame([("a", 0.0, 10.0), ("a", 2.0, 3.0), ("a", 9.0, 12.0)], "k string, start double, end double")
    assert [tuple(r) for r in intervals.merge(df, ["k"], 1.0).orderBy("start").collect()] == [("a", 0.0, 3.0), ("a", 9.0, 12.0)]


def test_history(spark):
    h = spark.createDataFrame([("f", v, f"r{v}") for v in range(4)], "k string, version int, regions string")
    out = intervals.commit(h, spark.createDataFrame([("f", 1)], "k string, version int"), spark.createDataFrame([("f", "new")], "k string, regions string"), ["k"], 2)
    assert sorted((r.version, r.regions) for r in out.collect()) == [(1, "r1"), (2, "new")]


def test_nearest_takes_the_earlier(spark):
    left = spark.createDataFrame([(1, "u", 10.0), (2, "u", 50.0)], "id int, k string, t double")
    right = spark.createDataFrame([("u", 8.0), ("u", 12.0)], "k string, t double")
    got = {r.id: r.matched for r in matching.nearest(left, right, ["k"], "t", "t", 5.0, "id").collect()}
    assert got == {1: 8.0, 2: None}


def test_metric_strength(spark):
    rows = spark.range(16).select(slices.metric_strength(F.col("id").cast("int"), F.lit(4), F.lit(16)).alias("s")).collect()
    assert [r.s for r in rows][:9] == [1.0, 0.1625, 0.225, 0.1625, 0.55, 0.1625, 0.225, 0.1625, 0.75]


def test_empty_and_null(spark):
    empty = spark.createDataFrame([], "k string, start double, end double")
    assert intervals.merge(empty, ["k"], 1.0).count() == 0
    assert inclusion.none_included(spark.createDataFrame([], "included boolean"), inclusion.included("included")).first().none
    assert one(spark, aggregates.classify_hit(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0))) == "perc"
    assert one(spark, aggregates.looks_percussive(F.lit(None).cast("double"), F.lit(5.0))) is False
