"""Different texts stay different, whatever their hashes do."""

import random

import numpy as np
import pyarrow as pa
import pytest

from sonarframe.llm import near_dedup, packing, substring_dedup
from sonarframe.llm import textnum as N
from test_dedup import WORD, brute_spans, table


def thue_morse(n, one="a", other="b"):
    return "".join(other if bin(i).count("1") % 2 else one for i in range(n))


PAIR = thue_morse(1024), thue_morse(1024, "b", "a")


def test_words_of_two_symbols_differ():
    for size in (64, 100, 128, 1024, 2048):
        for seed in (0, 1):
            (part,) = N.slices(pa.array([thue_morse(size) + " " + thue_morse(size, "b", "a")]))
            assert len(set(part.word_hashes(seed).tolist())) == 2


def test_runs_depend_on_every_word_and_its_place():
    draw = np.random.default_rng(3)
    base = draw.integers(0, 2**63, 64, dtype=np.int64).astype(np.uint64)
    for k in (1, 2, 5, 17, 50):
        whole = N.runs(base, k)
        assert len(whole) == 65 - k and len(set(whole.tolist())) == len(whole)
        assert np.array_equal(N.runs(base[3 : 3 + k], k), whole[3:4])
        for i in range(k):
            other = base[:k].copy()
            other[i] ^= np.uint64(1)
            assert N.runs(other, k)[0] != whole[0]
    assert not len(N.runs(base[:3], 5))


def test_same_bytes():
    data = np.frombuffer(b"abcdefghijklmnop-abcdefghijklmnoq", dtype=np.uint8)
    at8 = N.eights(data)
    one, other, size = (np.array(x) for x in ([0, 0, 0, 3], [17, 17, 17, 20], [16, 15, 8, 0]))
    assert N.same_bytes(at8, one, at8, other, size).tolist() == [False, True, True, True]


def test_colliding_words_keep_their_tokens():
    encoder = packing.Encoder(packing.default_tokenizer(), weaken=2)
    draw = random.Random(5)
    texts = [" ".join([*PAIR, *("".join(draw.choice("abcdé") for _ in range(draw.randrange(1, 40))) for _ in range(200))]) for _ in range(3)]
    for part in N.slices(pa.array(texts)):
        for _ in range(2):
            ids, offsets = encoder.ids(part)
            for d, text in enumerate(texts):
                assert ids[offsets[d] : offsets[d + 1]].tolist() == [*encoder.tokenizer.encode(text, add_special_tokens=False).ids, packing.END_ID]


def test_encoder_starts_again_when_full(monkeypatch):
    monkeypatch.setattr(packing, "MAX_WORDS", 50)
    encoder, draw = packing.Encoder(packing.default_tokenizer()), random.Random(6)
    for _ in range(4):
        text = " ".join("".join(draw.choice("abcdef") for _ in range(draw.randrange(1, 15))) for _ in range(40)) + " " + "x" * 500
        (part,) = N.slices(pa.array([text]))
        assert encoder.ids(part)[0].tolist() == [*encoder.tokenizer.encode(text, add_special_tokens=False).ids, packing.END_ID]


def test_near_duplicates_of_colliding_words(spark):
    got = near_dedup.near_duplicates(table(spark, list(enumerate(PAIR)))).collect()
    assert {(r.doc_id, r.component_id, r.kept) for r in got} == {(0, 0, True), (1, 1, True)}


def test_spans_of_colliding_words(spark):
    same = [f"w{i}" for i in range(49)]
    rows = [(i, " ".join([*same, w])) for i, w in enumerate(PAIR)]
    assert [r.n_removed for r in substring_dedup.digest(table(spark, rows)).collect()] == [0, 0]


@pytest.fixture(scope="module")
def passages():
    draw = random.Random(8)
    word = lambda: f"v{draw.randrange(60)}"
    common = [[word() for _ in range(draw.randrange(40, 130))] for _ in range(6)]
    rows = []
    for i in range(60):
        parts = []
        for _ in range(draw.randrange(1, 5)):
            parts += [word() for _ in range(draw.randrange(0, 40))]
            c = list(draw.choice(common))
            if draw.random() < 0.5:
                c[draw.randrange(len(c))] = word()
            parts += c
        rows.append((i, " ".join(parts)))
    rows += [(60, " ".join(["a"] * 130)), (61, " ".join(["a"] * 90)), (62, " ".join(["a", "b"] * 60)), (63, " ".join(["a", "b"] * 40 + ["a"] * 70))]
    return rows


@pytest.mark.parametrize("weaken", [0, 40, 1])
@pytest.mark.parametrize("window", [50, 10])
def test_spans_whatever_edges_collide(spark, passages, window, weaken):
    """Edges that hash together form paths of different words; their digests tell, and the result is the same."""
    want = {i: (n, gone) for i, (n, gone, _) in brute_spans(passages, window).items()}
    got = substring_dedup.remove_repeats(table(spark, passages), window=window, weaken=weaken).collect()
    assert {r.doc_id: (r.n_words, r.n_removed) for r in got} == want


def test_one_id_with_two_texts(spark, passages):
    """Each row keeps its own words: spans are found by row, sources by id."""
    rows = passages[:20] + [(5, passages[7][1]), (3, passages[7][1]), (0, " ".join(f"z{i}" for i in range(200)))]
    got = substring_dedup.remove_repeats(table(spark, rows)).collect()
    first = {}
    tokens = [(i, WORD.findall(t)) for i, t in rows]
    for i, w in tokens:
        for k in range(len(w) - 49):
            first[tuple(w[k : k + 50])] = min(first.get(tuple(w[k : k + 50]), i), i)
    want = []
    for i, w in tokens:
        gone = {p for k in range(len(w) - 49) if first[tuple(w[k : k + 50])] < i for p in range(k, k + 50)}
        want.append((i, len(w), len(gone)))
    assert sorted((r.doc_id, r.n_words, r.n_removed) for r in got) == sorted(want)


def brute_paths(rows, window):
    """Paths of repeated edges by following unique neighbours, from edges found by the operator's nodes."""
    edges, near = {}, {}
    for i, t in rows:
        for part in N.slices(pa.array([t])):
            nodes = substring_dedup.Nodes(part, window)
            e = [0, *nodes.edge.tolist(), 0]
            for a, b, c in zip(e, e[1:], e[2:]):
                edges.setdefault(b, set()).add(i)
                near.setdefault(b, set()).add((a, c))
    repeated = {e for e, docs in edges.items() if len(docs) > 1}
    before = {e: {a for a, _ in near[e]} for e in repeated}
    after = {e: {c for _, c in near[e]} for e in repeated}
    paths = 0
    for e in repeated:
        (p,) = before[e] if len(before[e]) == 1 else (0,)
        paths += not (p in repeated and after[p] == {e})
    return len(repeated), paths


def test_compacted_paths(spark, passages):
    found = substring_dedup.repeated_paths(table(spark, passages))
    n_edges, n_paths = brute_paths(passages, 50)
    assert found.select("path").distinct().count() == n_paths < n_edges


def test_text_beyond_a_block_of_positions(spark):
    """Positions are numbered by blocks of 2^15 words: repeats across their ends are found."""
    draw = random.Random(9)
    long = [f"q{draw.randrange(10**6)}" for _ in range(70_000)]
    rows = [(1, " ".join(long)), (2, " ".join(long[32_700:32_860])), (3, " ".join(long[65_500:65_600]) + " end"), (4, "x " + " ".join(long[10:70]))]
    got = {r.doc_id: (r.n_words, r.n_removed) for r in substring_dedup.remove_repeats(table(spark, rows)).collect()}
    assert got == {1: (70_000, 0), 2: (160, 160), 3: (101, 100), 4: (61, 60)}
