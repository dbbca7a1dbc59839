"""Token alignment against whole texts, byte by byte."""

import hashlib
import random
from collections import Counter

import pytest

from sonarframe.llm import alignment


def brute(texts):
    import sentencepiece
    from tokenizers import Tokenizer

    path_a, path_b = alignment.default_tokenizers()
    a, b = Tokenizer.from_file(path_a), sentencepiece.SentencePieceProcessor(model_file=path_b)
    a.encode_special_tokens = True
    symbols = alignment.byte_symbols()
    out, counts = [], Counter()
    for t in texts:
        whole = (" " + (t or "")).encode()
        ids_a, ids_b = (a.encode(" " + t, add_special_tokens=False).ids, b.encode(t)) if t else ([], [])
        bytes_a = [bytes(symbols[c] for c in a.id_to_token(i)) for i in ids_a]
        bytes_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
        if not t or b"".join(bytes_a) != whole or b"".join(bytes_b) != whole:
            out.append(((0, 0, 0, 0, 0), "", []))
            continue
        spans = []
        for parts in (bytes_a, bytes_b):
            at, found = 0, []
            for p in parts:
                found.append((at, at + len(p)))
                at += len(p)
            spans.append(found)
        shared = sorted({e for _, e in spans[0]} & {e for _, e in spans[1]})
        links = [(x, y) for x, (_, e) in zip(ids_a, spans[0]) for y, (_, f) in zip(ids_b, spans[1]) if e == f] if len(whole) < 3000 else [(ids_a[[e for _, e in spans[0]].index(e)], ids_b[[f for _, f in spans[1]].index(e)]) for e in shared]
        overlaps = sum(1 for s, e in spans[0] for u, v in spans[1] if s < v and u < e) if len(whole) < 3000 else None
        groups, before = [], 0
        for e in shared:
            groups.append("|".join(",".join(str(i) for i, (s, _) in zip(ids, span) if before <= s < e) for ids, span in ((ids_a, spans[0]), (ids_b, spans[1]))))
            before = e
        counts.update(links)
        out.append(((len(ids_a), len(ids_b), len(groups), len(links), overlaps), hashlib.sha256(";".join(groups).encode()).hexdigest(), links))
    best = {}
    for (_, y), n in counts.items():
        best[y] = max(best.get(y, 0), n)
    return [(*facts, digest, sum(counts[x] == best[x[1]] for x in links), sum(counts[x] for x in links)) for facts, digest, links in out]


def texts():
    draw = random.Random(4)
    out = [None, "", " ", "   ", "a", " leading", "trailing ", "two  spaces   three", "line\n \n next\n\n  x\t\ty", "non  breaking   y　 z", "<|endoftext|> <s> </s> <0x41>", "under▁score", "emoji 👩‍👩‍👧 ⅷ ﬁ", "é é ñ", "\x00 \x01\x1c \x1c x", "it's we'll 'd 1234567 ¼½", "x" * 5000, "the " * 900]
    alphabet = ["the", "of", "thatioon", "Été", "über", " ", "\n", "\t", "  ", "'s", "!?", "123", "日本語", " ", " ", "ﷺ", "\u0085"]
    out += ["".join(draw.choice(alphabet) + draw.choice(["", " "]) for _ in range(draw.randrange(1, 60))) for _ in range(300)]
    return out + [out[20], out[20]]


@pytest.mark.parametrize("most_pairs", [1 << 22, 0])
def test_alignment_of_whole_texts(spark, most_pairs, monkeypatch):
    rows = texts()
    docs = spark.createDataFrame([(i, t, "clash", 3) for i, t in enumerate(rows)], "doc_id long, text string, pairs string, uid int")
    got = {r.doc_id: r for r in alignment.statistics(docs, most_pairs=most_pairs).collect()}
    assert len(got) == len(rows)
    for i, (n_a, n_b, n_groups, n_links, n_overlaps, digest, n_best, count_sum) in enumerate(brute(rows)):
        r = got[i]
        assert (r.n_a, r.n_b, r.n_groups, r.n_links, r.groups_sha256, r.n_best, r.count_sum) == (n_a, n_b, n_groups, n_links, digest, n_best, count_sum), rows[i]
        assert n_overlaps is None or r.n_overlaps == n_overlaps


def test_alignment_in_parts_and_with_a_full_cache(monkeypatch):
    rows = texts()
    known = alignment.Aligner(*alignment.default_tokenizers())
    whole = alignment._batch(known, rows)
    for name, value in (("_CHARACTERS", 20), ("_PART", 3), ("MAX_KEPT", 40), ("LONG", 2)):
        monkeypatch.setattr(alignment, name, value)
    parts = alignment._batch(alignment.Aligner(*alignment.default_tokenizers()), rows)
    for x, y in zip(whole, parts):
        assert list(map(str, x)) == list(map(str, y))


def test_alignment_of_few_rows(spark):
    assert alignment.statistics(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    got = alignment.statistics(spark.createDataFrame([(None, "a b"), (None, None)], "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.n_groups) for r in got) == [(None, 0), (None, 2)]
