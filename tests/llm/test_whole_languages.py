"""Language filters hold every n-gram of every language, once seen or rare, in one shard or many."""

import numpy as np

from sonarframe.llm import kneser_ney, language_id


def grams(text):
    data = np.frombuffer(text.encode(), dtype=np.uint8)
    return np.unique(kneser_ney._grams(kneser_ney.codes(data), np.array([0, len(data)]), language_id.ORDER))


def values(found, text):
    """Whether each language contains each n-gram of ``text``."""
    known = [s.value for s in found.shards]
    keys = grams(text)
    of = language_id._product(keys) % np.uint64(len(known))
    masks = np.concatenate([known[i].languages_of(keys[of == i])[0] for i in range(len(known))])
    return [(masks >> i) & 1 for i in range(len(found.langs))]


def test_every_gram_of_every_language(spark):
    draw = np.random.default_rng(4)
    word = lambda letters, n: "".join(draw.choice(list(letters), n))
    common = "the same words in both "
    large = [(common * 20 + word("abcdef", 60), "aa") for _ in range(300)]
    rare = [(common + word("uvwxyz", 4000), "bb")]  # its n-grams are seen once; the shared ones at a small rate
    labelled = spark.createDataFrame(large + rare, "text string, lang string")
    one, many = language_id.fit(labelled), language_id.fit(labelled, shard_grams=500)
    assert len(one.shards) == 1 < len(many.shards)
    for found in (one, many):
        assert found.langs == ["aa", "bb"]
        assert values(found, rare[0][0])[1].all()
        assert all(values(found, text)[0].all() for text, _ in large[:20])
    texts = labelled.toArrow().column("text")
    a, b = one.shares(texts), many.shares(texts)
    assert np.allclose(a, b, atol=0.03) and (a.argmax(axis=1) == b.argmax(axis=1)).all()
    assert a[-1].argmax() == 1 and (a[:-1].argmax(axis=1) == 0).all()
    assert a[-1, 1] > 0.95


def test_shards_in_workers(spark, monkeypatch):
    docs = spark.createDataFrame([(i, ("kind words here" if i % 2 else "bad terms there") * 3, "en" if i % 2 else "de") for i in range(200)], "doc_id long, text string, lang string")
    fit, sizes = language_id.fit, []

    def several(labelled):
        found = fit(labelled, shard_grams=10)
        sizes.append(len(found.shards))
        return found

    monkeypatch.setattr(language_id, "fit", several)
    got = language_id.predict(docs).collect()
    assert sizes[0] > 1 and all(r.lang_pred == ("en" if r.doc_id % 2 else "de") for r in got)
