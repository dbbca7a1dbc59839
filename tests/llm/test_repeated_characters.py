"""Texts of one repeated character: decontamination in bounded memory, and what it finds."""

import random
import tracemalloc

import numpy as np
import pytest

from sonarframe.llm import decontaminate
from sonarframe.llm.decontaminate import REGION, Items, points
from test_models import edits


def search(known, text):
    t = points(decontaminate.normalise(text) + "\n")
    return {known.ids[k] for _, k, _, _ in known.search(t, np.zeros(len(t), dtype=np.int64))}


@pytest.mark.parametrize("unit", ["=", "=-", "abc ", "- = + "])
def test_ruler_lines(unit):
    """A text of 200,000 characters against items of the same pattern takes under 200 MB beyond its own arrays."""
    known = Items([(1, unit * (500 // len(unit))), (2, "what is the capital of the country " + unit * 60)], region=REGION)
    tracemalloc.start()
    found = search(known, unit * (200_000 // len(unit)))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found == {1, 2} and peak < 200e6


def test_runs_lose_nothing():
    """Items with repeated passages, edited within their budget, are found wherever they stand."""
    draw = random.Random(2)
    word = lambda: "".join(draw.choice("abcdefgh") for _ in range(draw.randrange(2, 7)))
    for trial in range(30):
        pieces = [word() for _ in range(3)]
        item = " ".join(draw.choice(pieces) for _ in range(40))
        edited = list(item)
        for _ in range(decontaminate.budget(len(item))):
            at = draw.randrange(len(edited))
            edited[at : at + 1] = draw.choice([[], ["z"], [edited[at], "y"]])
        text = " ".join(word() for _ in range(draw.randrange(80))) + " " + "".join(edited) + " " + " ".join(word() for _ in range(50))
        near = edits(item, decontaminate.normalise(text)) <= decontaminate.budget(len(item))  # an edit beside a space counts twice
        assert search(Items([(trial, item)]), text) == ({trial} if near else set())
        assert search(Items([(trial, item)]), " ".join(word() for _ in range(200))) == set()


def test_many_blocks_give_what_one_gives(spark, monkeypatch):
    draw = random.Random(3)
    word = lambda: "".join(draw.choice("abcdefghijklm") for _ in range(draw.randrange(2, 9)))
    items = [(i, " ".join(word() for _ in range(draw.randrange(2, 40)))) for i in range(20)]
    docs = [(i, " ".join([word() for _ in range(30)] + [items[i % 20][1]] * (i % 3) + [word() for _ in range(20)])) for i in range(60)]
    d, b = spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string")
    one = sorted(map(tuple, decontaminate.passages(d, b, region=REGION).collect()))
    monkeypatch.setattr(decontaminate, "BLOCK_CHARS", 300)
    monkeypatch.setattr(decontaminate, "SLICE_DOCS", 7)
    monkeypatch.setattr(decontaminate, "MOST_EXPANDED", 50)
    assert one and sorted(map(tuple, decontaminate.passages(d, b, region=REGION).collect())) == one
    assert decontaminate.passages(d, b.limit(0)).count() == 0
