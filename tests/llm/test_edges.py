"""Cases that tables of documents rarely have: one class only, ties, clashing identifiers, very long texts, nulls at every stage."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from sonarframe.llm import chat, decontaminate, exact_dedup, language_id, packing, quality, toxicity, url_filters
from test_dedup import brute_near
from test_models import edits

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


def test_quality_ties_go_to_smaller_ids():
    raw = np.concatenate(list(quality.terms(pa.array(["same words here"] * 40 + ["other text 123"] * 40))))
    for first in (0, 1):
        labels = np.array([first] * 31 + [1 - first] * 9 + [0] * 40)
        assert quality.Space(raw, labels, rank=4).vote(raw[:1])[0] == first


def test_quality_of_repeated_ids(spark):
    """Rows that share an id don't multiply what is learnt from."""
    docs = spark.createDataFrame([(i % 5 + 1, f"text {i % 5} " * (i % 5 + 1)) for i in range(200)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 6)] * 3, "doc_id long, label int")
    space = quality.fit(docs, labels.distinct())
    assert len(space.labels) == 5 and quality.fit(docs, labels.where("doc_id > 9")) is None


@pytest.mark.parametrize("only", [0, 1])
def test_one_class_only(spark, only):
    docs = spark.createDataFrame([(i, f"some words {i}") for i in range(40)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, only, only) for i in range(40)], "doc_id long, quality int, toxic int")
    assert {r.predicted for r in toxicity.score(docs, labels).collect()} == {0}
    assert {r.predicted for r in quality.score(docs, labels).collect()} == {only}
    assert toxicity.keep_clean(docs, labels).count() == 40


def test_language_ties(spark):
    """Equal shares go to the language with more rows, then to the first by name."""
    rows = [(i, "abc abc", "zz" if i % 3 else "aa") for i in range(1, 40)] + [(100, "abc abc", None)]
    got = language_id.predict(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert got.where("doc_id = 100").first().lang_pred == "zz"
    even = [(i, "abc abc", ("bb", "aa")[k]) for k, ids in enumerate(((1, 2, 3, 6), (4, 5, 7, 8))) for i in ids]
    learnt = language_id.fit(spark.createDataFrame([r[1:] for r in even], "text string, lang string"))
    share = learnt.shares(pa.array(["abc abc"]))
    assert learnt.langs == ["aa", "bb"] and (share + 1e-9 * learnt.prior).argmax() == 0


def test_many_languages(spark):
    """A dirty column of languages gives more filters, not a larger plan."""
    name = lambda i: "".join(chr(97 + i // 26**k % 26) for k in range(2))
    rows = [(i, f"qq{name(i % 150)}zz{name(i % 150)} " * 5, f"l{i % 150:03}") for i in range(1, 900)]
    got = language_id.predict(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    assert np.mean([r.lang_pred == f"l{r.doc_id % 150:03}" for r in got]) > 0.95 and all(0 <= r.score <= 1 for r in got)


def test_rules_for_one_verdict_only(spark):
    pages = spark.createDataFrame([(None, "http://a.com/x"), (1, "http://b.com/y"), (2, "http://c.org/z"), (2, "http://c.org/z")], "page_id long, url string")
    got = url_filters.judge(pages).collect()
    assert [r.verdict for r in got] == ["allow"] * 4 and sorted(r.rule or "" for r in got) == ["", "", "com/", "com/"]


def test_probe_in_the_table(spark):
    rows = [(-1, 5, "user", "own"), (7, None, None, None), (7, 0, "assistant", "x" * 300_000 + "<|im_end|>")]
    got = {r.conv_id: r for r in chat.digest(spark, spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert got[-1].n_turns == 3 and got[7].n_turns == 2 and got[7].loss_chars == 300_010
    assert got[7].turns_sha256 == hashlib.sha256(("\n\nassistant\n" + "x" * 300_000 + "<|im_end|>\n").encode()).hexdigest()


def test_exact_very_long_texts(spark):
    long = "word " * 400_000
    rows = [(1, long), (2, long + "x"), (3, long), (4, None), (5, "")]
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in exact_dedup.digest(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: (3, 2, False), 2: (2, 1, True), 3: (3, 2, True), 4: (5, 2, False), 5: (5, 2, True)}


def test_packing_levels(spark, monkeypatch):
    """Small demes, level after level: nothing is lost, and sequences stay near the bound."""
    draw = random.Random(3)
    items = spark.createDataFrame([(i, draw.randrange(1, 1400)) for i in range(1500)], "uid long, length long")
    got = packing.assign(items, deme=60).collect()
    lengths = {r.uid: r.length for r in items.collect()}
    fills = {}
    for r in got:
        fills[r.sequence_id] = fills.get(r.sequence_id, 0) + lengths[r.uid]
    assert sorted(r.uid for r in got) == sorted(lengths) and max(fills.values()) <= 2048
    assert len(fills) <= 1.02 * sum(lengths.values()) / 2048 + 1


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """Toxic, equal, near-equal and contaminated documents, with nulls and repeated rows."""
    draw = random.Random(21)
    word = lambda: "".join(draw.choice("abcdefghij") for _ in range(draw.randrange(2, 8)))
    text = lambda n: " ".join(word() for _ in range(n))
    items = [(i, text(18)) for i in range(3)] + [(3, None)]
    rows, labels = [], []
    for i in range(160):
        toxic = i % 4 == 0
        rows.append((i, text(40) + (" vile wretched scum " if toxic else " ") + text(15)))
        labels.append((i, 1, int(toxic)))
    clean = [r for r in rows if r[0] % 4]
    rows += [(200 + i, clean[i][1]) for i in range(8)]  # copies
    for i in range(8):  # near copies
        w = clean[20 + i][1].split()
        w[10] = "changed"
        rows.append((220 + i, " ".join(w)))
    rows += [(240 + i, text(30) + " " + items[i % 3][1].upper() + " " + text(20)) for i in range(6)]
    rows += [(250 + i, text(30) + " " + items[i][1][20:100] + " " + text(20)) for i in range(3)]  # parts
    rows += [(260, None), (261, ""), (None, text(30)), (262, text(3)), (263, "x" * 30_000)]
    rows.append(rows[-1])
    path = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], DOCUMENTS).repartition(4).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, items


def brute_contaminated(text, items):
    t = decontaminate.normalise(text)
    for _, item in items:
        if item:
            p = decontaminate.normalise(item)
            n = decontaminate.REGION
            windows = [p, *(p[a : a + n] for a in {*range(0, len(p) - n, decontaminate.STRIDE), len(p) - n})]
            if any(edits(w, t) <= decontaminate.budget(len(w)) for w in windows):
                return True
    return False


def test_pipeline_against_brute_force(spark, corpus, tmp_path):
    """Each stage on what the one before kept, against what its rule says."""
    path, items = corpus
    docs = spark.read.parquet(f"{path}/documents.parquet")
    sides = []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, path).write.parquet(str(tmp_path / str(i)))
        sides.append([(r.doc_id, r.text) for r in docs.collect()])
        docs = spark.read.parquet(str(tmp_path / str(i)))
    by = lambda rows: sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] or ""))
    first, second, third, fourth, fifth = map(by, sides)
    assert [r for r in first if r[0] is None or r[0] >= 200 or r[0] % 4] == [r for r in second if r[0] is None or r[0] >= 200 or r[0] % 4], "clean documents stay"
    assert sum(r[0] is not None and r[0] < 160 and r[0] % 4 == 0 for r in second) <= 2, "toxic ones go"
    kept = {}
    for i, t in second:
        kept[t or ""] = max(kept.get(t or "", -1), -1 if i is None else i)
    assert [(-1 if i is None else i, t or "") for i, t in third] == by((i, t) for t, i in kept.items()) or sorted((-1 if i is None else i, t or "") for i, t in third) == sorted((i, t) for t, i in kept.items())
    numbered = [r for r in third if r[0] is not None]
    components = brute_near(numbered)
    assert [r for r in fourth if r[0] is not None] == [r for r in numbered if components[r[0]][1] == r[0]]
    assert fifth == [r for r in fourth if r[0] is None or not brute_contaminated(r[1] or "", items)]
    assert {r.doc_id for r in docs.collect()} == {i for i, _ in fifth}


def test_pipeline_stages_on_empty_tables(spark, corpus, tmp_path):
    path, _ = corpus
    empty = spark.read.parquet(f"{path}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, empty, path)
        assert out.count() == 0, name
        if name != "pack":
            assert out.columns == empty.columns, name


def test_run_gives_the_last_stage(spark, corpus):
    path, _ = corpus
    out = corpus_pipeline.run(spark, path)
    assert {"doc_id", "piece", "sequence_id", "offset"} <= set(out.columns) and out.count() > 0
