import random

import pytest

from ledgerlens.llm.queries import tokenizer_path
from ledgerlens.llm.token_counts import Counter, token_counts

PARTS = ["a", "b", " ", "  ", "\n", "\t", "'s", "'re", "'", "é", "1", "23", "!", "...", "<|endoftext|>", "<|endof", "text|>",
         " x", "　", " ", "\x1c", "漢字", "😀", "don't", " 'll", "\r\n", "   "]


@pytest.fixture(scope="module")
def path():
    return tokenizer_path()


def test_counts_equal_the_library(path):
    rng = random.Random(9)
    whole = Counter(path)
    for k in range(1500):
        text = "".join(rng.choice(PARTS) for _ in range(rng.randint(0, 60)))
        chunk, overlap = rng.choice([(16, 5), (40, 28), (64, 30)])
        cut = Counter.__new__(Counter)
        cut.__dict__.update(whole.__dict__, chunk=chunk, overlap=overlap)
        want = len(whole.tokenizer.encode(text, add_special_tokens=False))
        assert whole.count([text]) == [want], text
        assert cut.count([text]) == [want], (text, chunk, overlap)


@pytest.mark.parametrize("text", ["a" * 5000, " " * 5000, "word " * 3000, "<|endoftext|>" * 400, "x\n" * 4000, "é" * 3000 + " z" * 900])
def test_long_texts_are_spliced_exactly(path, text):
    cut = Counter(path, chunk=512, overlap=32)
    assert cut.count([text]) == [len(cut.tokenizer.encode(text, add_special_tokens=False))]


def test_cache_may_overflow(path):
    c = Counter(path, cache=20)
    texts = [" ".join(f"w{i}{j}" for j in range(30)) for i in range(10)]
    assert c.count(texts) == [len(c.tokenizer.encode(t, add_special_tokens=False)) for t in texts]


def test_other_tokenizers_are_encoded_whole():
    c = Counter(tokenizer_path("word_bpe_49k.json"))
    assert not c.sliceable
    assert c.count(["Some text here", None]) == [len(c.tokenizer.encode("Some text here", add_special_tokens=False)), 0]


def test_operator(spark, docs_of, path):
    docs = [(1, None), (2, ""), (3, "Hello world"), (3, "Hello world"), (None, "é"), (4, "word " * 600)]
    got = sorted([tuple(r) for r in token_counts(docs_of(docs), path).collect()], key=str)
    n = lambda t: len(Counter(path).tokenizer.encode(t, add_special_tokens=False))     # noqa: E731
    assert got == sorted([(d, len((t or "").encode()), n(t or ""), n(t or "") > 512) for d, t in docs], key=str)
    assert token_counts(docs_of([]), path).collect() == []
