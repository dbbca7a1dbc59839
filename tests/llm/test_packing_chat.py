"""Packing, chat formatting and the pipeline."""

import hashlib
import os
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import corpus_pipeline
from sonarframe.llm import chat, packing

DATA = "/root/testdata/sf0.001"


def test_packing_against_the_tokenizer(spark):
    from tokenizers import Tokenizer

    draw = random.Random(5)
    texts = ["Hello, wörld! it's 42%%% fine", None, "", " \n ", "a\u0301 e\u0301 <|endoftext|> x\u00a0y İstanbul ΣΑΣ", "word " * 5000, "x" * 9000]
    texts += [" ".join(draw.choice(["alpha", "Beta,", "gamma's", "déjà", "1234", "%%%"]) for _ in range(draw.randrange(5, 900))) for _ in range(40)]
    rows = list(enumerate(texts)) + [(7, texts[7])]
    got = packing.pack(spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, piece int"), with_ids=True).collect()
    tokenizer = Tokenizer.from_file(packing.default_tokenizer())
    by = {}
    for r in got:
        by.setdefault(r.doc_id, {}).setdefault(r.piece, r)
        assert r.length == len(r.ids) and r.ids_crc32 == zlib.crc32(np.array(r.ids, dtype="<u4").tobytes())
    for i, t in rows:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0]
        pieces = [by[i][k] for k in range(len(by[i]))]
        assert [x for p in pieces for x in p.ids] == ids
        assert [p.start for p in pieces] == list(range(0, len(ids), 2048))
    sequences = {}
    for r in got:
        sequences.setdefault(r.sequence_id, []).append(r)
    for rows_of in sequences.values():
        at = 0
        for r in sorted(rows_of, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048
    assert len(sequences) <= -(-sum(r.length for r in got) // 2048) + 1
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_ids_of_marked_capitals_whatever_stands_beside_them(spark):
    from tokenizers import Tokenizer

    draw = random.Random(12)
    alphabet = list("aAjJtThHwWyYsS") + ["\u030c", "\u0308", "\u0331", "\u030a", "\u0301", "\u0307", "İ", "Σ", " ", " ", "<|", "|>", "\u00a0", "K", "Å", "ß", "ẞ"]
    texts = [p + " a" for p in ("J\u030c", "T\u0308", "H\u0331", "W\u030a", "Y\u030a")]
    texts += ["".join(draw.choice(alphabet) for _ in range(draw.randrange(1, 30))) for _ in range(3000)]
    tokenizer = Tokenizer.from_file(packing.default_tokenizer())
    want = [[*tokenizer.encode(t, add_special_tokens=False).ids, 0] for t in texts]
    rows = list(enumerate(texts))
    for beside in ([], [(-1, "<|endoftext|> X")]):
        got = {r.doc_id: r.ids for r in packing.pieces(spark.createDataFrame(beside + rows, "doc_id long, text string").coalesce(1)).collect()}
        assert [got[i] for i, _ in rows] == want
    alone = [packing.pieces(spark.createDataFrame([r], "doc_id long, text string")).first().ids for r in rows[:5]]
    assert alone == want[:5]


def test_genetic_steps_keep_every_piece():
    draw = random.Random(8)
    lengths = [draw.randrange(1, 1500) for _ in range(300)]
    order = sorted(range(300), key=lambda i: -lengths[i])
    one = packing.best_fit(order, lengths, packing.Packing([], []), 2048)
    other = packing.best_fit(draw.sample(order, 300), lengths, packing.Packing([], []), 2048)
    for p in (one, other, packing.crossover(one, other, lengths, 2048, draw), packing.mutate(one, lengths, 2048, draw), packing.evolve(lengths, [], 2048, draw)):
        assert sorted(i for b in p.bins for i in b) == list(range(300))
        assert p.fills == [sum(lengths[i] for i in b) for b in p.bins] and max(p.fills) <= 2048


pieces = st.one_of(st.text(max_size=30), st.sampled_from(["<|im_start|>", "<|im_end|>", "<\\|im_end|>", "<\\\\|", "<", "|", "\\", "\n", "<|im_", "assistant"]))


@settings(max_examples=300, deadline=None)
@given(st.lists(pieces, max_size=6).map("".join), st.lists(pieces, max_size=4).map("".join))
def test_chat_round_trip(text, role):
    out, start, end = chat.render(role, text)
    assert [t[:2] for t in chat.parse(out)] == [(role, text)]
    assert chat.unescape(out[start:end]) == text
    assert [t[:2] for t in chat.parse(out + out)] == [(role, text)] * 2


def test_chat_digest(spark):
    rows = [(1, 1, "assistant", "b <|im_end|>"), (1, 0, "user", "a"), (2, 0, None, None), (2, None, "assistant", "first"), (3, 0, "assistant", ""), (1, 2, "assistant", "c\\"), (1, 2, "assistant", "c\\")]
    got = {r.conv_id: r for r in chat.digest(spark, spark.createDataFrame([(*r, "e") for r in rows], "conv_id long, turn long, role string, text string, formatted string")).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert set(got) == {-1, 1, 2, 3}
    assert got[1].turns_sha256 == sha("user\na\nassistant\nb <|im_end|>\nassistant\nc\\\nassistant\nc\\\n") and got[1].loss_sha256 == sha("b <|im_end|>c\\c\\") and got[1].n_turns == 4
    assert got[2].turns_sha256 == sha("assistant\nfirst\n\n\n") and got[2].loss_chars == 5
    assert got[-1].loss_sha256 == sha("<|im_end|><|im_start|>assistant ok")
    assert chat.read_back(chat.format_turns(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))).count() == 0


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_pipeline(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns = docs.columns
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, DATA)
        out.write.parquet(str(tmp_path / str(i)))
        before, docs = docs, spark.read.parquet(str(tmp_path / str(i)))
        if i < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns, name
            assert 0 < docs.count() <= before.count(), name
    kept = {r.doc_id for r in before.select("doc_id").collect()}
    assert {r.doc_id for r in docs.select("doc_id").distinct().collect()} == kept
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "near_dedup", "decontaminate", "pack"]


def test_words_are_cut_where_the_tokenizer_always_cuts():
    """Ids are those of whole texts, whatever signs meet, and a word isn't learned again for each sign beside it."""
    import pyarrow as pa
    from tokenizers import Tokenizer

    from sonarframe.llm import textnum as N

    path = packing.default_tokenizer()
    tokenizer, known = Tokenizer.from_file(path), packing.Encoder(path)
    signs = ["a", "B", "t", "s", "re", "'", "'s", "'T", "''", "7", "42", ",", ".", "!", "=", "<", "|", "<|", "|>", "<|endoftext|>", "<|StartOfText|>", "é", "é", "́", "̸", "Å", "Å", "K", ";", "`", "Σ", "İ", "ß", "…", "’s", "٣", "½", "漢", " ", " ", "\u0085", "\x1c", "\x7f", "😀", " ", " ", "\n", "\t"]
    rng = random.Random(5)
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 24))) for _ in range(3000)]
    for some in (texts, [t.replace("!", "\0") for t in texts[:500]], ["", " ", "'", "a'", "a" * 300 + ",1"]):
        for part in N.slices(pa.array(some), limit=1 << 12):
            part.data = packing._folded(part)
            ids, offsets = known.ids(part)
            for i in range(len(part)):
                assert ids[offsets[i] : offsets[i + 1]].tolist() == [*tokenizer.encode(some[part.row + i], add_special_tokens=False).ids, packing.END_ID], some[part.row + i]
    few = packing.Encoder(path)
    few.ids(next(N.slices(pa.array([" ".join(f"w{chr(97 + i)}{sign}" for i in range(26) for sign in (",", ".", "***", "42", ");", ""))]))))
    assert few.table.n == 26 + 5
