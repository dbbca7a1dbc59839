"""Very long texts, null ids and odd labels at the operators that the other tests don't take them to."""

import random

import numpy as np
import pytest

from sonarframe.llm import decontaminate, language_id, near_dedup, packing, quality, toxicity, url_filters

WORDS = "alpha beta gamma delta river stone cloud paper window garden".split()


def words(draw, n):
    return " ".join(draw.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    draw = random.Random(1)
    rows = [(i, words(draw, 30) + (" zorglub zorglub" if i % 3 == 0 else " fine")) for i in range(240)]
    return rows, [(i, int(i % 3 == 0), int(i % 3 == 0)) for i in range(240)]


def test_long_texts_and_null_ids_of_the_classifiers(spark, corpus):
    rows, labels = corpus
    draw = random.Random(2)
    odd = [(1000, words(draw, 120_000)), (1001, words(draw, 120_000) + " zorglub" * 20_000), (None, words(draw, 20)), (None, None), (1002, "")]
    docs = spark.createDataFrame(rows + odd, "doc_id long, text string")
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    for found in (toxicity.score(docs, known), quality.score(docs, known)):
        got = found.collect()
        assert len(got) == len(rows) + len(odd)
        assert all(0 <= r.score <= 1 for r in got) and all(r.held_out for r in got if r.doc_id is None)
    long = {r.doc_id: r.score for r in toxicity.score(docs, known).collect()}
    assert long[1001] > 0.5 > long[1000]
    assert toxicity.keep_clean(docs, known).where("doc_id is null").count() == 2


def test_an_empty_language_has_its_name(spark):
    rows = [(i, "xyzzy plugh " * 4, "") for i in range(1, 40)] + [(i, "alpha beta " * 4, "aa") for i in range(40, 80)] + [(90, "plugh xyzzy " * 60_000, None), (None, "alpha beta", "aa")]
    got = {r.doc_id: r.lang_pred for r in language_id.predict(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert got[90] == "" and got[50] == "aa" and got[None] == "aa" and len(got) == 81


def test_null_ids_are_packed(spark):
    got = packing.pack(spark.createDataFrame([(None, "a b c"), (None, None), (1, "a b c")], "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.length) for r in got) == [(0, 1), (0, 4), (1, 4)]


def test_near_duplicates_of_very_long_texts(spark):
    draw = random.Random(3)
    base = [f"w{draw.randrange(10**6)}" for _ in range(45_000)]
    assert len(" ".join(base)) > 1 << 18
    near = [w if i % 40 else "x" for i, w in enumerate(base)]
    rows = [(5, " ".join(base)), (3, " ".join(near)), (9, " ".join(f"v{w}" for w in base)), (None, " ".join(base))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.component_id, r.kept) for r in near_dedup.near_duplicates(docs).collect()}
    assert got == {5: (3, False), 3: (3, True), 9: (9, True), None: (None, True)}
    assert sorted(r.doc_id or 0 for r in near_dedup.keep_one(docs).collect()) == [0, 3, 9]


def test_urls_that_are_long_or_say_nothing(spark):
    rows = [(i, f"http://a{i}.com/x/{i}") for i in range(60)] + [(100 + i, f"http://b{i}.net/es/x/{i}") for i in range(60)]
    rows += [(None, "http://c.org/" + "rose/" * 60_000), (None, None), (900, "no scheme"), (901, "")]
    got = url_filters.judge(spark.createDataFrame(rows, "page_id long, url string")).collect()
    assert len(got) == len(rows) and {r.verdict for r in got} <= {"allow", "block"}
    only = url_filters.judge(spark.createDataFrame(rows[:60] + rows[-4:], "page_id long, url string")).collect()  # nothing is blocked: nothing to compare
    assert {r.verdict for r in only} == {"allow"}


def test_passages_in_very_long_texts_and_rows_without_an_id(spark):
    draw = random.Random(4)
    item = " ".join(f"item{draw.randrange(999)}" for _ in range(30))
    rows = [(1, words(draw, 90_000) + " " + item + " " + words(draw, 90_000)), (2, words(draw, 180_000)), (None, "so " + item), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    benchmark = spark.createDataFrame([(7, item), (None, item), (8, None)], "item_id long, text string")
    got = decontaminate.passages(docs, benchmark, region=decontaminate.REGION).collect()
    assert sorted(((r.doc_id or 0), r.item_id, r.edits) for r in got) == [(0, 7, 0), (1, 7, 0)]
    assert sorted(r.doc_id or 0 for r in decontaminate.keep_clean(docs, benchmark).collect()) == [0, 0, 2]
    assert np.isclose(got[0].similarity, 1)
