"""Models keep every gram, however many there are: against brute force and across numbers of shards."""

import math
from collections import Counter, defaultdict

import numpy as np
import pytest

import corpus_pipeline
from sonarframe.llm import kneser_ney, toxicity, url_filters

LETTERS = np.frombuffer(b"abcdefghijklmnopqrstuvwxyz  ", dtype=np.uint8)


def random_text(draw, n):
    return LETTERS[draw.integers(0, len(LETTERS), n)].tobytes().decode()


def brute(texts, order=6, shared=3):
    """f(context and byte) = log P(byte | yes) - log P(byte | no), by dictionaries."""
    counts = [Counter(), Counter()]
    for text, label in texts:
        padded = b"\n" * (order - 1) + text.encode()
        counts[1 - label].update(padded[i : i + order] for i in range(len(padded) - order + 1))
    levels = {order: counts}
    for n in range(order - 1, 0, -1):
        grams = [set(c) for c in levels[n + 1]]
        if n <= shared:
            grams = [grams[0] | grams[1]] * 2
        levels[n] = [Counter(g[1:] for g in kind) for kind in grams]
    stats = {}
    for n, both in levels.items():
        for c, found in enumerate(both):
            one, two = (sum(v == k for v in found.values()) for k in (1, 2))
            total, kinds = defaultdict(int), defaultdict(int)
            for g, v in found.items():
                total[g[:-1]] += v
                kinds[g[:-1]] += 1
            stats[n, c] = one / (one + 2 * two) if one and two else 0.75, total, kinds

    def prob(gram, c):
        if not gram:
            return 1 / 256
        d, total, kinds = stats[len(gram), c]
        lower, t = prob(gram[1:], c), total.get(gram[:-1], 0)
        return (max(levels[len(gram)][c][gram] - d, 0) + d * kinds[gram[:-1]] * lower) / t if t else lower

    def difference(gram):
        return math.log(prob(gram, 0) / prob(gram, 1))

    difference.log_prob = lambda gram, c: math.log(prob(gram, c))
    return difference


def test_kneser_ney_beyond_a_shard(spark):
    """More grams than one shard has by default: each still counts, the rare class's seen once too."""
    draw = np.random.default_rng(8)
    texts = [(random_text(draw, 9000), int(i % 12 == 0)) for i in range(150)]
    model = kneser_ney.train(spark.createDataFrame(texts, "text string, label int").repartition(3))
    want = brute(texts)
    assert len(model.shards) > 1
    for text in (texts[0][0][:400], texts[1][0][:400], random_text(draw, 400)):
        data = np.frombuffer(text.encode(), dtype=np.uint8)
        got = model.differences(data, np.array([0, len(data)]))
        padded = b"\n" * 5 + text.encode()
        assert np.allclose(got, [want(padded[i : i + 6]) for i in range(len(text))], atol=1e-4)


@pytest.mark.parametrize("shard_grams", [50, 700])
def test_shards_change_nothing(spark, shard_grams):
    draw = np.random.default_rng(9)
    docs = spark.createDataFrame([(i, random_text(draw, 90) + (" vile" if i % 3 == 0 else " fine")) for i in range(60)], "doc_id long, text string")
    known = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(60)], "doc_id long, label int")
    column = docs.toArrow().column("text")
    one, many = (toxicity.fit(docs, known, shard_grams=n) for n in (1 << 20, shard_grams))
    assert len(one.model.shards) == 1 < len(many.model.shards)
    assert np.allclose(one.scores(column), many.scores(column), atol=1e-6)
    scored = docs.mapInArrow(lambda batches: (type(b).from_arrays([b.column("doc_id"), __import__("pyarrow").array(many.scores(b.column("text")))], ["doc_id", "p"]) for b in batches), "doc_id long, p double")
    assert np.allclose([r.p for r in scored.orderBy("doc_id").collect()], one.scores(column), atol=1e-6)


def test_urls_beyond_a_shard(spark):
    """The ratio of undecided URLs comes from all grams of decided ones."""
    draw = np.random.default_rng(10)
    path = lambda n: random_text(draw, n).replace(" ", "-")
    urls = [f"http://a.com/{path(9000)}" for _ in range(190)] + [f"http://x.net/es/{path(60)}" for _ in range(40)] + [f"http://b.org/{path(50)}" for _ in range(10)]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").repartition(3)
    got = {r.page_id: r for r in url_filters.judge(pages).collect()}
    texts = [(u, int(got[i].verdict == "allow")) for i, u in enumerate(urls) if got[i].rule]
    assert len({t[i : i + 6] for t, _ in texts for i in range(len(t))}) > 1 << 20
    want = brute(texts)
    for i in range(225, 240):
        padded = b"\n" * 5 + urls[i].encode()
        assert abs(got[i].ratio - np.mean([want(padded[k : k + 6]) for k in range(len(urls[i]))])) < 1e-4


def test_pipeline_drops_rare_toxic_words(spark, tmp_path):
    """Toxic words are each seen a few times, clean grams more often and in a larger number than a shard has."""
    draw = np.random.default_rng(11)
    words = [random_text(draw, 12).replace(" ", "q") for _ in range(40)]
    texts = [random_text(draw, 9000) * 8 for _ in range(320)]
    texts += [random_text(draw, 150) + (" " + words[i % 40] + " " if i < 280 else "") + random_text(draw, 50) for i in range(560)]
    toxic = [320 <= i < 600 for i in range(len(texts))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    spark.createDataFrame([(i, 1, int(t)) for i, t in enumerate(toxic)], "doc_id long, quality int, toxic int").coalesce(1).write.parquet(str(tmp_path / "labels.parquet"))
    kept = {r.doc_id for r in corpus_pipeline.drop_toxic(spark, docs, str(tmp_path)).select("doc_id").collect()}
    assert np.mean([i in kept for i, t in enumerate(toxic) if t]) < 0.1
    assert np.mean([i in kept for i, t in enumerate(toxic) if not t]) > 0.95
