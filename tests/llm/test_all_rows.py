"""Every labelled row is counted; stages bear columns of any name; rows of different documents that share a hash stay apart."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from sonarframe.llm import decontaminate, exact_dedup, kneser_ney, near_dedup, substring_dedup, toxicity, url_filters


def test_rows_of_the_calibration_count_too(spark):
    ids = [(r.i, r.part) for r in spark.range(600).select(F.col("id").alias("i"), F.pmod(F.xxhash64("id"), F.lit(4)).alias("part")).collect()]
    draw = np.random.default_rng(3)
    words = "alpha beta gamma delta river stone cloud paper".split()
    text = lambda i, part: " ".join(draw.choice(words, 12)) + ((" zorglub" if part == 0 else " vile") if i % 2 else "")
    docs = spark.createDataFrame([(i, text(i, part)) for i, part in ids], "doc_id long, text string")
    known = spark.createDataFrame([(i, i % 2) for i, _ in ids], "doc_id long, label int")
    found = toxicity.fit(docs, known)
    with_word, without = found.scores(pa.array(["alpha beta zorglub gamma", "alpha beta gamma"]))
    assert with_word > 0.5 > without
    # the model that scores is the one of all rows
    whole = kneser_ney.train(docs.join(known, "doc_id"))
    data = np.frombuffer(b"river zorglub vile stone", dtype=np.uint8)
    ends = np.array([0, len(data)])
    assert np.allclose(found.model.differences(data, ends), whole.differences(data, ends), atol=1e-5)


def test_urls_that_calibrate_count_too(spark):
    urls = [f"http://a{i}.com/garden/rose{i % 7}" for i in range(120)] + [f"http://b{i}.net/es/casino{i % 7}" for i in range(120)] + ["http://c.org/es/casino1", "http://d.org/garden/rose3"]
    frame = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string")
    got = {r.page_id: r for r in url_filters.judge(frame).collect()}
    decided = [(u, int(got[i].rule is not None and got[i].verdict == "allow")) for i, u in enumerate(urls) if got[i].rule is not None]
    means = url_filters._means(kneser_ney.train(spark.createDataFrame(decided, "text string, label int")), pa.array(urls))
    assert np.allclose([got[i].ratio for i in range(len(urls))], means, atol=1e-5)


def test_all_decided_urls_calibrate(spark, monkeypatch):
    """Each is in one fold, scored by a model that hasn't counted it; a fit over the table is the one over arrays."""
    urls = [f"http://a{i}.com/garden/rose{i % 7}" for i in range(90)] + [f"http://b{i}.net/es/casino{i % 7}" for i in range(70)] + ["http://c.org/x"]
    seen = {}

    def fit(rows, x, y):
        seen["rows"] = [(r[y], r[x]) for r in rows.collect()]
        return seen.setdefault("weights", kneser_ney.logistic_over(rows, x, y))

    monkeypatch.setattr(url_filters, "logistic_over", fit)
    url_filters.judge(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"))
    label, ratio = np.array(seen["rows"], dtype=float).T
    assert len(label) == 160 and label.sum() == 90
    assert np.allclose(seen["weights"], kneser_ney.logistic(ratio[:, None], label), rtol=1e-6)


def test_stages_bear_columns_of_any_name(spark, tmp_path):
    rows = [(1, "some words that repeat here and there", 1, "a", None, 2.0), (2, "some words that repeat here and there", 2, "b", None, 2.0), (None, None, 3, "c", None, 2.0)]
    names = "doc_id long, text string, gone int, __gone__ string, here string, `there` double"
    frame = spark.createDataFrame([(*r[:2], *r[2:]) for r in rows], names).withColumn("GONE_", F.lit(1)).withColumn("here_", F.lit(1)).withColumn("__here__", F.lit(1)).withColumn("__there__", F.lit(1))
    frame.write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    labels = spark.createDataFrame([(1, 0)], "doc_id long, toxic int")
    benchmark = spark.createDataFrame([(1, "something else that nobody says in any text at all")], "item_id long, text string")
    ids = lambda df: sorted((r.doc_id or 0 for r in df.collect()))
    for df, want in ((toxicity.keep_clean(docs, labels), [0, 1, 2]), (exact_dedup.deduplicate(docs), [0, 2]), (exact_dedup.deduplicate(frame), [0, 2]), (near_dedup.keep_one(docs), [0, 1]), (decontaminate.keep_clean(docs, benchmark), [0, 1, 2])):
        assert df.columns == docs.columns and ids(df) == want


def test_rows_that_share_a_hash_stay_apart(spark, monkeypatch):
    """Spans of one document don't cut another whose row hash is the same."""
    monkeypatch.setattr(substring_dedup, "row_key", lambda docs: docs.withColumn("row", F.lit(7).cast("long")))
    long = " ".join(f"w{i}" for i in range(80))
    rows = [(1, long), (2, "x " + long + " y"), (3, " ".join(f"v{i}" for i in range(90))), (4, "short")]
    got = {r.doc_id: (r.n_words, r.n_removed) for r in substring_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: (80, 0), 2: (82, 80), 3: (90, 0), 4: (1, 0)}


def test_comparing_by_bands_gives_the_same_components(spark, monkeypatch):
    """All nodes of a group, or band by band, with the constants that production has: the same links on families around the threshold."""
    draw = np.random.default_rng(11)
    rows = []
    for family in range(12):
        base = [f"f{family}w{i}" for i in draw.integers(0, 40, 60)]
        for _ in range(25):
            words = list(base)
            for at in draw.integers(0, 60, draw.integers(0, 5)):
                words[at] = f"n{draw.integers(0, 10**6)}"
            rows.append((len(rows), " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = []
    for most in (near_dedup.MOST_BLOCKS, 0):
        monkeypatch.setattr(near_dedup, "MOST_BLOCKS", most)
        found.append(sorted(tuple(r) for r in near_dedup.near_duplicates(docs).collect()))
    assert found[0] == found[1]
