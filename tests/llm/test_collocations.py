"""Collocations against a count of all phrases, and the stack at chunk and range edges."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sonarframe.llm import collocations as C

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, least, top, covers=100, most=5):
    n, f = Counter(), {}
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(UPPER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for i in range(len(words)):
                for m in range(1, most + 1):
                    if i + m <= len(words):
                        of = f.setdefault(lang, Counter())
                        of[tuple(words[i : i + m])] += 1
    out = []
    for lang, of in f.items():
        gone = {p[i : i + m] for p, b in of.items() if b >= least for m in range(2, len(p)) for i in range(len(p) - m + 1) if 100 * b >= covers * of[p[i : i + m]]}
        found = []
        for p, a in of.items():
            if len(p) > 1 and a >= least and p not in gone:
                s, k = min((1000 * a * n[lang] // (of[p[:k]] * of[p[k:]]), k) for k in range(1, len(p)))
                found.append((-s, -a, " ".join(p).encode(), of[p[:k]], of[p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, l, r, n[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(found)[:top])]
    return sorted(out)


def corpus(draw, n):
    words = ["the", "The", "of", "a", "quick", "été", "b\x00c", "b", "b\x01", "\x01", "\x00", "\x02x", "b\x1f", "w" * 300, "w" * 299 + "v", "日本", "rare%d"]
    rows = []
    for _ in range(n):
        text = "".join((w % draw.randrange(500) if "%d" in w else w) + draw.choice([" ", " ", " ", "  ", "\t", ", ", ".", "\n", " \x0b"]) for w in draw.choices(words, k=draw.randrange(0, 60)))
        rows.append((text + draw.choice(["", "new york city hall", "New York  City hall of", "x"]), draw.choice(["en", "en", "en", "fr", None, "", "und"])))
    return rows + [(None, "en"), ("", "de"), ("of the " * 3000, "en")]


@pytest.mark.parametrize("least,top,covers", [(5, 2000, 100), (3, 7, 60), (2, None, 100)])
def test_against_all_phrases(spark, least, top, covers, monkeypatch):
    monkeypatch.setattr(C, "_ROWS", 7)
    monkeypatch.setattr(C, "_PAIRS", 50)
    rows = corpus(random.Random(least), 250)
    docs = spark.createDataFrame([(t, lang, 5, "x") for t, lang in rows], "text string, lang string, n int, phrase string").repartition(5)
    got = C.mine(docs, least=least, top=top, covers=covers).collect()
    assert sorted(tuple(r) for r in got) == brute(rows, least, top or 10**9, covers)


def test_colliding_hashes_stay_apart(spark, monkeypatch):
    rows = corpus(random.Random(9), 80)
    spans = C.N.hash_spans
    weak = lambda *a: spans(*a) % np.uint64(7)
    words = [C.Words(part) for part in C.N.slices(pa.array([t or "" for t, _ in rows]), fold_case=True)]
    for w in words:
        monkeypatch.setattr(C.N, "hash_spans", weak)
        size = C._lengths(w.goes_on, np.ones(len(w.starts), dtype=bool), 5)
        at, n = C._distinct(w, w.hashes(), np.zeros(len(rows), dtype=np.int32), size, 5)
        said = lambda i, w=w, size=size: tuple(w.data[w.starts[j] : w.ends[j]].tobytes() for j in range(i, i + size[i]))
        found = Counter()
        for i, c in zip(at.tolist(), n.tolist()):
            found[said(i)] += c
        assert found == Counter(said(i) for i in range(len(size)) if size[i])


def test_stack_is_the_same_for_all_chunks():
    draw = random.Random(3)
    rows = sorted({(draw.choice("de"), "\x00".join(draw.choice(["a", "ab", "b"]) for _ in range(draw.randrange(1, 6)))) for _ in range(300)}, key=lambda r: r[1], reverse=True)
    rows = [r for lang in "de" for r in rows if r[0] == lang]
    want = Counter()
    for i, (lang, s) in enumerate(rows):
        w = s.split("\x00")
        for m in range(1, len(w) + 1):
            want[lang, "\x00".join(w[:m])] += i + 1
    for step in (1, 2, 5, 1000):
        stack, got = C.Stack(5, 1), Counter()
        for i in range(0, len(rows), step):
            part = rows[i : i + step]
            out = stack.push(pa.array([r[0] for r in part]), pa.array([r[1] for r in part]), np.arange(i, i + len(part)) + 1, i + step >= len(rows))
            for r in out.to_pylist():
                assert (r["lang"], r["phrase"]) not in got  # one row each: nothing is counted in parts
                got[r["lang"], r["phrase"]] = r["n"]
        assert got == want


def test_scores_beyond_64_bits(spark):
    a, n, left, right = 3 * 10**12 + 1, 9 * 10**15 + 7, 4 * 10**12 + 3, 10**13 + 9
    row = spark.createDataFrame([(a, n, left, right)], "a long, n long, l long, r long").select(C.score(F.col("a"), F.col("n"), F.col("l"), F.col("r")).alias("s")).first()
    assert row.s == 1000 * a * n // (left * right)


def test_nothing_to_mine(spark):
    assert C.mine(spark.createDataFrame([], "text string, lang string")).count() == 0
    assert C.mine(spark.createDataFrame([(None, None), ("", "en"), ("one two", "en")], "text string, lang string")).count() == 0
