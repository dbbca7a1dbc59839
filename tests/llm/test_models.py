"""Classifiers by held-out accuracy and edge cases, decontamination and URL rules against brute force."""

import os
import random

import numpy as np
import pytest

from sonarframe.llm import decontaminate, kneser_ney, language_id, quality, toxicity, url_filters
from sonarframe.llm.table import KeyTable

DATA = "/root/testdata/sf0.01"
needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{DATA}/labels.parquet")


def held(df, labels, name):
    return [(r.score, r.predicted, r[name]) for r in df.join(labels, "doc_id").where("held_out").collect()]


@needs_data
def test_quality(documents, labels):
    rows = held(quality.score(documents, labels), labels, "quality")
    assert np.mean([p == y for _, p, y in rows]) > 0.95


@needs_data
def test_toxicity(documents, labels):
    rows = held(toxicity.score(documents, labels), labels, "toxic")
    assert np.mean([p == y for _, p, y in rows]) > 0.93
    assert all(p == (s >= 0.5) for s, p, _ in rows)


@needs_data
def test_language(documents):
    rows = language_id.predict(documents).join(documents.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert np.mean([r.lang == r.lang_pred for r in rows]) > 0.98


def small(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, score double, held_out string, label string")


def test_models_on_edges(spark):
    rows = [(i, "kind words here" if i % 2 else "bad words there", "en" if i % 2 else "de", 1.0, "x", "y") for i in range(400)]
    rows += [(900, None, "en", 1.0, "x", "y"), (901, "", None, 1.0, "x", "y"), (902, "12 34 --", "en", 1.0, "x", "y"), (902, "12 34 --", "en", 1.0, "x", "y"), (None, "kind", None, 1.0, "x", "y"), (903, "kind words " * 20000, None, 1.0, "x", "y")]
    docs = small(spark, rows)
    labels = spark.createDataFrame([(i, i % 2, 1 - i % 2) for i in range(300)] + [(None, 1, 1), (901, None, None)], "doc_id long, quality int, toxic int")
    for found in (quality.score(docs, labels), toxicity.score(docs, labels)):
        got = found.collect()
        assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    tox = {r.doc_id: r.predicted for r in toxicity.score(docs, labels).collect()}
    assert all(tox[i] == 1 - i % 2 for i in range(400))
    langs = {r.doc_id: r for r in language_id.predict(docs).collect()}
    assert langs[900].lang_pred == langs[901].lang_pred == langs[902].lang_pred == "und" and langs[900].score == 0
    assert langs[903].lang_pred == "en" and all(langs[i].lang_pred == ("en" if i % 2 else "de") for i in range(400))
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.score for r in quality.score(docs, none).collect()} == {0.5}
    assert {r.predicted for r in toxicity.score(docs, none).collect()} == {0}
    assert language_id.predict(small(spark, [])).count() == 0 and quality.score(small(spark, []), labels).count() == 0


def test_bloom_masks_hold_every_language():
    draw = np.random.default_rng(2)
    grams = draw.integers(1, 2**40, 5000).astype(np.uint64)
    contains = draw.random((5000, 70)) < 0.3  # two words of languages
    f = language_id.Filters([f"l{i:02}" for i in range(70)], np.full(70, 1 / 70), grams, contains)
    masks = f.languages_of(grams)
    for i in (0, 5, 63, 64, 69):
        assert ((masks[i // 64] >> np.uint64(i % 64)) & np.uint64(1)).astype(bool)[contains[:, i]].all()
    assert (f.false < 0.05).all()


def test_a_text_does_not_see_the_one_before():
    text = "abracadabra alakazam " * 30
    data = np.frombuffer(text.encode(), dtype=np.uint8)
    keys, n = np.unique(kneser_ney._grams(kneser_ney.codes(data), np.array([0, len(data)]), 6), return_counts=True)
    model = kneser_ney.Model(keys, n, np.zeros_like(n))
    d = model.differences(data, np.array([0, len(data)]))
    assert len(d) == len(data) and np.isfinite(d).all()
    again = model.differences(np.concatenate([data, data]), np.array([0, len(data), 2 * len(data)]))
    assert np.array_equal(again[: len(data)], d) and np.array_equal(again[len(data) :], d)


def test_key_table():
    keys = np.unique(np.random.default_rng(3).integers(0, 2**63, 50_000).astype(np.uint64))
    t = KeyTable(keys)
    assert np.array_equal(t.find(keys), np.arange(len(keys)))
    assert (t.find(keys + np.uint64(1))[~np.isin(keys + np.uint64(1), keys)] == -1).all()


def brute_rule(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host, tail = rest[:cut], rest[cut:]
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
        path = tail[: min([tail.find(c) for c in "?#" if c in tail] or [len(tail)])]
    fits = [(len(h + p), h + p, v) for v, h, p in url_filters.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, *((max(fits)[1:]) if fits else (None, None))


def test_url_rules(spark):
    urls = ["http://a.com/x", "https://A.COM", "http://example.com/en/1?q#f", "http://m.example.com/en/", "http://www.example.com/en/2", "http://x.net/es/3", "http://x.net/de/3", "http://notexample.com/en/", "com/", None, "", "http://", "x://y://z/", "http://b.org?p=/en/", "http://com/#/en/", "http://u@h.net:80/fr/x\n/y"] * 2
    pages = spark.createDataFrame([(i, u, "h", "r", "v") for i, u in enumerate(urls)], "page_id long, url string, host string, rule string, verdict string")
    got = {r.page_id: r for r in url_filters.judge(pages).collect()}
    assert len(got) == len(urls)
    for i, u in enumerate(urls):
        host, path, rule, verdict = brute_rule(u)
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule)
        assert got[i].verdict == verdict if verdict else got[i].verdict in ("allow", "block")
    assert url_filters.judge(pages.limit(0)).count() == 0


def edits(pattern, text):
    """Fewest edits of an occurrence of ``pattern`` anywhere in ``text``."""
    row = np.zeros(len(text) + 1, dtype=int)
    for i, c in enumerate(pattern, 1):
        new = np.empty_like(row)
        new[0] = i
        for j, d in enumerate(text, 1):
            new[j] = min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (c != d))
        row = new
    return int(row.min())


def test_decontamination(spark):
    draw = random.Random(6)
    word = lambda: "".join(draw.choice("abcdefgh") for _ in range(draw.randrange(2, 8)))
    text = lambda n: " ".join(word() for _ in range(n))
    items = [(i, text(14 + i)) for i in range(8)] + [(50, "short"), (51, None), (None, text(20))]

    def changed(t, n):
        t = list(t)
        for _ in range(n):
            at, how = draw.randrange(len(t)), draw.randrange(3)
            t[at : at + 1] = [] if how == 0 else [draw.choice("xyz")] if how == 1 else [t[at], draw.choice("xyz")]
        return "".join(t)

    docs = []
    for i in range(60):
        item = items[i % 8][1]
        docs.append((i, text(20) + "  \n" + changed(item.upper() if i % 3 else item, i // 8) + " " + text(15) if i % 5 else text(60), "e"))
    docs += [(100, None, "e"), (101, "", "e"), (102, items[2][1], "e"), (102, items[2][1], "e"), (None, items[3][1], "e")]
    got = {(r.doc_id, r.item_id): r.edits for r in decontaminate.passages(spark.createDataFrame(docs, "doc_id long, text string, item_id string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    for d, t, _ in docs:
        for k, p in items:
            if t is None or p is None or k is None:
                continue
            a, b = decontaminate.normalise(p), decontaminate.normalise(t)
            far = edits(a, b) if len(a) >= decontaminate.LEAST_CHARS else 10**6
            assert ((d, k) in got) == (far <= decontaminate.budget(len(a))), (d, k, far)
            if (d, k) in got:
                assert got[d, k] == far or far <= got[d, k] <= decontaminate.budget(len(a))
    clean = decontaminate.keep_clean(spark.createDataFrame(docs, "doc_id long, text string, item_id string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {100, 101} <= {r.doc_id for r in clean.collect()} and 102 not in {r.doc_id for r in clean.collect()}
