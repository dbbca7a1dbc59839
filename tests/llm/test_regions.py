"""Parts of benchmark items and short items in documents."""

import random

from sonarframe.llm import decontaminate


def test_parts_and_short_items(spark):
    draw = random.Random(12)
    word = lambda: "".join(draw.choice("abcdefgh") for _ in range(draw.randrange(2, 8)))
    text = lambda n: " ".join(word() for _ in range(n))
    long = [text(60) for _ in range(6)]
    items = [*enumerate(long), (50, "Short  item"), (51, "xyz"), (52, None), (53, "  "), (54, "uvw xyz uvw xyz uvw")]
    docs = [(i, text(40) + " " + t[: len(t) // 2] + " " + text(40)) for i, t in enumerate(long)]  # half an item
    docs += [(10 + i, text(20) + " " + t[: -len(t) * 8 // 100] + " " + text(20)) for i, t in enumerate(long)]  # all but the last
    docs += [(20 + i, text(20) + " " + t[90 + i : 150 + i].upper() + " " + text(20)) for i, t in enumerate(long)]  # 60 characters from anywhere
    docs += [(30 + i, text(20) + " " + t[:70] + "qq" + t[72:150] + " " + text(20)) for i, t in enumerate(long)]  # with edits
    docs += [(40 + i, text(200)) for i in range(20)]  # clean
    docs += [(70, "a short item, b"), (71, "(XYZ)"), (72, "shortitem wxyz xyza"), (73, "xyz"), (74, "uvw xyz  uvw\nxyz uvw"), (75, None), (76, "")]
    docs, items = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    rows = decontaminate.passages(docs, items, region=decontaminate.REGION).collect()
    got = {(r.doc_id, r.item_id) for r in rows}
    want = {(at + i, i) for at in (0, 10, 20, 30) for i in range(6)} | {(70, 50), (71, 51), (73, 51), (74, 51), (74, 54)}
    assert got == want and len(rows) == len(want)
    assert all(0 <= r.similarity <= 1 and r.passage_end > 0 for r in rows)
    kept = {r.doc_id for r in decontaminate.keep_clean(docs, items).collect()}
    assert kept == {*range(40, 60), 72, 75, 76}
