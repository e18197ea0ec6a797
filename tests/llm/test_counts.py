"""Operator 11 against the library on whole texts."""

import random

import pytest

from cardweir.llm import token_counts
from cardweir.llm.tokens import tokenizer_path


def library(texts, name="byte_bpe_50k.json"):
    from tokenizers import Tokenizer

    return [len(e.ids) for e in Tokenizer.from_file(tokenizer_path(name)).encode_batch(texts, add_special_tokens=False)]


def odd_text(rng, pieces):
    parts = ["word", "Word's", "don't", " ", "  ", "\n\n", "\t", "日本語", "é", "é", "🙂", "<|endoftext|>", "<|endof", "12345", "...", "a" * 30, " " * 20, "'", "'re", " ", "x\r\n"]
    return "".join(rng.choice(parts) + (" " if rng.random() < 0.4 else "") for _ in range(pieces))


def test_counts_of_cut_texts_against_whole_ones(frame):
    rng = random.Random(5)
    texts = [odd_text(rng, rng.randrange(5, 300)) for _ in range(150)]
    texts += ["b" * 3000, " " * 2500, "日" * 900, "ab" * 40 + " " * 90 + "<|endoftext|>" * 60, "x " * 4000 + "y" * 700 + " z" * 300]
    rows = list(enumerate(texts)) + [(3, texts[3]), (None, texts[7])]
    want = sorted(((d, len(t.encode()), n, n > 100) for (d, t), n in zip(rows, library([t for _, t in rows]))), key=str)
    for chunk, overlap in ((60, 30), (200, 40), (500, 64)):
        got = token_counts.count_tokens(frame(rows), limit=100, chunk=chunk, overlap=overlap)
        assert sorted(map(tuple, got.collect()), key=str) == want
        assert got.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]


def test_counts_of_odd_rows(frame):
    rows = [(1, None), (2, ""), (None, None), (4, "a b"), (4, "a b"), (5, "<|endoftext|>"), (6, "long text " * 30_000)]
    got = token_counts.count_tokens(frame(rows)).collect()
    want = library([t or "" for _, t in rows])
    assert sorted(((r.doc_id, r.n_tokens) for r in got), key=str) == sorted(((d, n) for (d, _), n in zip(rows, want)), key=str)
    assert token_counts.count_tokens(frame(rows).limit(0)).collect() == []


def test_only_proven_files_are_cut(frame):
    assert token_counts.counter(tokenizer_path()).margin == 15
    assert token_counts.counter(tokenizer_path("word_bpe_49k.json")).margin is None
    assert token_counts.counter(tokenizer_path("piece_bpe_32k.model")).margin is None
    text = "Some Words  to count. " * 40
    got = token_counts.count_tokens(frame([(1, text)]), name="word_bpe_49k.json", chunk=50, overlap=20).collect()
    assert [r.n_tokens for r in got] == library([text], "word_bpe_49k.json")
    model = token_counts.count_tokens(frame([(1, text)]), name="piece_bpe_32k.model", chunk=50, overlap=20).collect()
    import sentencepiece

    assert model[0].n_tokens == len(sentencepiece.SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model")).encode(text))


@pytest.mark.parametrize("length", [1, 59, 60, 61, 90, 91, 1000])
def test_spans_cover_the_text(length):
    at = token_counts.spans(length, 60, 30)
    assert at[0][0] == 0 and at[-1][1] == length
    assert all(b[0] < a[1] == b[0] + 30 for a, b in zip(at, at[1:]))
