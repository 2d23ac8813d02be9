"""Spliced counts against whole encodings."""

import random

import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")
tokenizers = pytest.importorskip("tokenizers")

from marketspark.llm import token_counts  # noqa: E402

PIECES = [
    "word", " word", "I'm", "'ll", " ", "  ", "\n", "\n\n ", "\t", "é", "漢字", "🙂", "👩‍👩‍👧", "123", " 45", "!!!", " --", " ", "　", "\x1c",
    "<|endoftext|>", "<|endof", "text|>", "<|", "a" * 90, " " * 70, "\n" * 65, "é" * 60, "?" * 80, "1" * 75, "xy<|endoftext|>", "İ", "́",
]


def text_from(rng: random.Random, n: int) -> str:
    return "".join(rng.choice(PIECES) for _ in range(n))


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(public_tokenizers.path(token_counts.TOKENIZER))


def whole(library, text):
    return len(library.encode(text, add_special_tokens=False).ids)


@pytest.mark.parametrize("chunk,overlap", [(16, 2), (40, 20), (64, 30), (200, 40)])
def test_splices_equal_whole_encodings(library, chunk, overlap):
    counts = token_counts.TokenCounter(public_tokenizers.path(token_counts.TOKENIZER), chunk, overlap)
    rng = random.Random(chunk)
    for _ in range(400):
        text = text_from(rng, rng.randrange(120))
        assert counts.count(text) == whole(library, text), repr(text)


def test_special_string_on_each_place_of_a_border(library):
    counts = token_counts.TokenCounter(public_tokenizers.path(token_counts.TOKENIZER), 64, 32)
    for shift in range(130):
        for gap in ("", "  ", "\n\n", " x"):
            text = "ab " * (shift // 3) + "c" * (shift % 3) + gap + "<|endoftext|>" + gap + " tail's end" * 20
            assert counts.count(text) == whole(library, text)


def test_remembered_words(library, monkeypatch):
    monkeypatch.setattr(token_counts, "REMEMBERED", 30)
    counts = token_counts.TokenCounter(public_tokenizers.path(token_counts.TOKENIZER))
    rng = random.Random(3)
    words = [p for p in PIECES if p.strip() == p and p] + ["line\nbreak", "<|endoftext|>s", "it's", "tab\there"]
    for _ in range(200):
        text = " ".join(rng.choice(words) for _ in range(rng.randrange(60))) + rng.choice(["", " ", "\n", "\n\n"])
        assert counts.count(text) == whole(library, text), repr(text)
        assert len(counts.known) <= 60


def test_one_run_longer_than_any_overlap(library):
    counts = token_counts.TokenCounter(public_tokenizers.path(token_counts.TOKENIZER), 1000, 50)
    for run in ("a", " ", "\n", "!", "é", "ab" * 7, "<|endoftext|>"):
        for text in (run * 9000, "start " + run * 5000 + " end " * 400):
            assert counts.count(text) == whole(library, text)


def test_other_vocabularies_encode_whole_texts():
    spm = pytest.importorskip("sentencepiece")
    path = public_tokenizers.path("piece_bpe_32k.model")
    text = "  some words\nand more " * 3000
    assert token_counts.TokenCounter(path).count(text) == len(spm.SentencePieceProcessor(model_file=path).encode(text))
    path = public_tokenizers.path("word_bpe_49k.json")
    counts = token_counts.TokenCounter(path)
    assert not counts.stateless
    assert counts.count(text) == len(tokenizers.Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids)


def test_rows(spark, library):
    long = " ".join(f"w{i}" for i in range(40_000))
    rows = [(1, "a b c", "x"), (1, "a b c", "y"), (None, "null id", "z"), (2, None, "n"), (3, "", "e"), (4, long, "l"), (5, "m" * 70_000, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    got = sorted((r["doc_id"] or 0, r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in token_counts.query(docs).collect())
    assert got == sorted((i or 0, len((t or "").encode()), n := whole(library, t or ""), n > 512) for i, t, _ in rows)
    assert token_counts.query(docs.where("doc_id < 0")).collect() == []
    assert token_counts.query(docs).columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
