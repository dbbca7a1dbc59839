"""Scores and predictions of the classifiers against brute-force versions of their methods."""

import math
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from sonarframe.llm import kneser_ney, language_id, quality, toxicity, url_filters
from sonarframe.llm import textnum as N
from test_models import brute_rule
from test_whole_models import brute, random_text


@pytest.mark.parametrize("c", [0, 1])
def test_probabilities_sum_to_one(c):
    """After any context, seen or not, the probabilities of all bytes are one together; the model gives their ratios."""
    draw = np.random.default_rng(4)
    texts = [(random_text(draw, 300), i % 2) for i in range(8)]
    want = brute(texts)
    data = np.frombuffer("".join(t for t, _ in texts).encode(), dtype=np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(t) for t, _ in texts])])
    labels = np.repeat([y for _, y in texts], [len(t) for t, _ in texts])
    keys, where = np.unique(kneser_ney._grams(data, offsets, 6), return_inverse=True)
    model = kneser_ney.Model(keys, np.bincount(where, labels == 1), np.bincount(where, labels == 0))
    for context in (b"\n\n\n\n\n", texts[0][0][40:45].encode(), texts[1][0][7:12].encode(), b"zqzqz", b"ab zz"):
        grams = [context + bytes([b]) for b in range(256)]
        got = [float(model.shards[0].of(np.array([int.from_bytes(g, "big")], dtype=np.uint64))[0]) for g in grams]
        assert np.allclose(got, [want(g) for g in grams], atol=1e-4)
        assert sum(math.exp(want.log_prob(g, c)) for g in grams) == pytest.approx(1, abs=1e-9)


def brute_features(text, difference):
    """Largest mean difference over passages of each length that end at any byte, mean over the text, log of the length."""
    coded = kneser_ney.codes(np.frombuffer(text.encode(), dtype=np.uint8)).tobytes()
    padded = b"\n" * 5 + coded
    d = [difference(padded[i : i + 6]) for i in range(len(coded))]
    if not d:
        return [0.0] * (len(toxicity.PASSAGES) + 2)
    return [max(sum(d[max(0, i + 1 - w) : i + 1]) / w for i in range(len(d))) for w in toxicity.PASSAGES] + [sum(d) / len(d), math.log1p(len(d))]


def test_toxicity_features_and_scores():
    draw = np.random.default_rng(5)
    texts = [(random_text(draw, 200) + (" awful slur" if i % 3 == 0 else " nice day"), int(i % 3 == 0)) for i in range(30)]
    coded = [(kneser_ney.codes(np.frombuffer(t.encode(), dtype=np.uint8)).tobytes().decode(), y) for t, y in texts]
    want = brute(coded)
    data = np.frombuffer("".join(t for t, _ in coded).encode(), dtype=np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(t) for t, _ in coded])])
    labels = np.repeat([y for _, y in coded], [len(t) for t, _ in coded])
    keys, where = np.unique(kneser_ney._grams(data, offsets, 6), return_inverse=True)
    model = kneser_ney.Model(keys, np.bincount(where, labels == 1), np.bincount(where, labels == 0))
    probe = ["", "You awful slur", "NICE day 42", random_text(draw, 100), "é awful"]
    got = np.concatenate([x for _, x in toxicity.features(model, pa.array(probe))])
    assert np.allclose(got, [brute_features(t, want) for t in probe], atol=1e-4)
    centre, scale, weights = got.mean(axis=0), got.std(axis=0) + 1e-9, np.linspace(-1, 1, got.shape[1] + 1)
    scores = toxicity.Classifier(model, weights, centre, scale).scores(pa.array(probe))
    assert np.allclose(scores, [1 / (1 + math.exp(-(sum(w * (v - c) / s for w, v, c, s in zip(weights, row, centre, scale)) + weights[-1]))) for row in got])


def test_quality_votes():
    """Cosines with every labelled vector, one by one, and the vote of the nearest; equally near ones are any of them."""
    draw = np.random.default_rng(6)
    texts = [random_text(draw, int(n)) for n in draw.integers(0, 400, 120)]
    raw = np.concatenate(list(quality.terms(pa.array(texts))))
    labels = draw.integers(0, 2, 80)
    space = quality.Space(raw[:80], labels, rank=16)
    got = space.vote(raw[80:])
    for row, score in zip(raw[80:], got):
        x = space._latent(row[None, :])[0].astype(float)
        cosines = np.array([float(np.dot(x, v) / max(1e-9, np.linalg.norm(x) * np.linalg.norm(v))) for v in space.vectors.astype(float)])
        near = np.argsort(-cosines)[: quality.NEIGHBOURS]
        weight = np.maximum(cosines[near], 1e-3) ** quality.SHARPNESS
        assert score == pytest.approx((weight * labels[near]).sum() / weight.sum(), abs=1e-3)


def test_quality_terms():
    """Byte pairs and shapes of a text against plain counting."""
    texts = ["Hello, hello hello WORLD!", "", "ab ab ab", "ünï"]
    raw = np.concatenate(list(quality.terms(pa.array(texts))))
    for text, row in zip(texts, raw):
        data, words = text.encode(), text.encode().split()
        pairs = Counter(int(quality._PAIR[a << 8 | b]) for a, b in zip(data, data[1:]))
        assert {i: int(n) for i, n in enumerate(row[: quality.TERMS]) if n} == dict(pairs)
        repeats = sum(a == b for a, b in zip(words, words[1:]))
        assert row[quality.TERMS + 3] == pytest.approx(1 - len(set(words)) / max(1, len(words)))
        assert row[quality.TERMS + 4] == pytest.approx(repeats / max(1, len(words)))


def test_language_shares(spark):
    """Masks hold every language of an n-gram; shares are the corrected, weighted hits of all n-grams of a text."""
    draw = np.random.default_rng(7)
    alphabets = {"aa": "abcdefgh ", "bb": "efghijkl ", "cc": "ijklmnop "}
    texts = [("".join(draw.choice(list(alphabets[lang]), 150)), lang) for lang in alphabets for _ in range(12)]
    found = language_id.fit(spark.createDataFrame(texts, "text string, lang string"))
    grams = lambda t: [(b"\n" * 4 + t.encode())[i : i + 5] for i in range(len(t))]
    counts = defaultdict(Counter)
    for t, lang in texts:
        counts[lang].update(grams(t))
    totals = {lang: sum(c.values()) for lang, c in counts.items()}
    (shard,) = [s.value for s in found.shards]
    probes = [t for t, _ in texts[::6]] + ["abc", ""]
    got = found.shares(pa.array(probes))
    for text, row in zip(probes, got):
        for k, lang in enumerate(found.langs):
            total = 0.0
            for g in grams(text):
                rate = {x: c[g] / totals[x] for x, c in counts.items()}
                has, leads = rate[lang] > 0, rate[lang] > 0 and rate[lang] >= language_id.CONTAINS * max(rate.values())
                hit = lambda h, f: (h - f) / (1 - f)
                total += language_id.CONTAINS * hit(has, shard.false[k]) + (1 - language_id.CONTAINS) * hit(leads, shard.false_leading[k])
            # a false positive of the filters may add what a hit adds
            assert row[k] == pytest.approx(min(1, max(0, total / max(1, len(text)))), abs=0.03)
    assert language_id.fit(spark.createDataFrame([], "text string, lang string")) is None


def test_url_verdicts_follow_the_models(spark):
    """URLs that no rule decides get the verdict of the larger likelihood, on words that the two classes don't share."""
    good, bad = [f"http://site{i}.com/garden/rose{i % 17}" for i in range(200)], [f"http://host{i}.net/es/casino{i % 17}" for i in range(200)]
    asked = [f"http://other{i}.org/{'garden/rose' if i % 2 else 'es/casino'}{i % 13}" for i in range(60)]
    urls = [*good, *bad, *asked]
    got = {r.page_id: r for r in url_filters.judge(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").repartition(3)).collect()}
    for i, u in enumerate(urls):
        rule, verdict = brute_rule(u)[2:]
        assert got[i].rule == rule
        assert got[i].verdict == (verdict or ("allow" if "garden" in u else "block"))
    ratios = {i: got[i].ratio for i in range(400, 460)}
    kept = [(u, 1) for u in good] + [(u, 0) for u in bad]
    model = kneser_ney.train(spark.createDataFrame(kept, "text string, label int"))
    means = url_filters._means(model, pa.array(asked))
    assert all((means[i - 400] > 0) == (ratios[i] > 0) for i in ratios)


def test_slices_are_lazy_and_whole():
    texts = pa.array(["a b", None, "", "c" * 1000, "d e f"])
    parts = list(N.slices(texts, limit=10))
    assert sum(len(p) for p in parts) == 5 and [len(p.starts) for p in parts] == [int(np.diff(p.word_offsets).sum()) for p in parts]
    assert sum(len(p.starts) for p in parts) == 6


def test_keys_are_sorted_themselves():
    """Counts and places of keys are those of a plain count, and cost far less than sorting the places does."""
    import time

    draw = np.random.default_rng(12)
    for size, kinds in ((0, 1), (1, 1), (70_000, 3), (200_000, 9_000), (65_536, 1 << 20)):
        keys, yes = draw.integers(0, kinds, size).astype(np.uint64) << np.uint64(28), draw.integers(0, 2, size).astype(np.uint64)
        if size:
            want, where = np.unique(keys, return_inverse=True)
            got = kneser_ney.tally(keys << np.uint64(1) | yes)
            assert all(np.array_equal(a, b) for a, b in zip(got, (want, np.bincount(where, yes == 1), np.bincount(where, yes == 0))))
        for shift in (0, 20):  # beyond six bytes, too
            some = [keys << np.uint64(shift), keys[: size // 3] << np.uint64(shift), keys[:0]]
            every, places = kneser_ney.distinct(iter(some))
            assert np.array_equal(every, np.unique(some[0]))
            assert all(np.array_equal(every[p], k) and len(p) == len(k) for k, p in zip(some, places))
    keys = draw.integers(0, 1 << 19, 1 << 20).astype(np.uint64) << np.uint64(28)

    def seconds(f):
        took = []
        for _ in range(3):
            start = time.process_time()
            f()
            took.append(time.process_time() - start)
        return min(took)

    plain = seconds(lambda: np.unique(keys, return_inverse=True))
    assert seconds(lambda: kneser_ney.tally(keys << np.uint64(1))) < 0.6 * plain
    assert seconds(lambda: list(kneser_ney._ranked(keys[i : i + 65536]) for i in range(0, len(keys), 65536))) < 0.8 * plain


def test_counts_of_many_slices(spark, monkeypatch):
    """Every gram of every text is counted by its label, however many are counted at once."""
    monkeypatch.setattr(kneser_ney, "COUNTED", 500)
    draw = np.random.default_rng(13)
    texts = [(random_text(draw, int(n)) if n else "", int(i % 3 == 0)) for i, n in enumerate(draw.integers(0, 400, 90))]
    want = {}
    for text, y in texts:
        padded = b"\n" * 5 + kneser_ney.codes(np.frombuffer(text.encode(), dtype=np.uint8)).tobytes()
        for i in range(len(padded) - 5):
            want.setdefault(int.from_bytes(padded[i : i + 6], "big"), [0, 0])[1 - y] += 1
    got = {r.gram: [r.yes, r.no] for r in kneser_ney.count(spark.createDataFrame(texts, "text string, label int").repartition(2)).collect()}
    assert got == want
