import random

import numpy as np
import pytest

from linderos.llm import token_counts as t

from .conftest import documents, empty


@pytest.fixture(scope="module")
def path(vocabulary):
    return vocabulary("word_bpe_49k.json")


@pytest.fixture(scope="module")
def tokenizer(path):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def library(tokenizer, texts):
    return [len(e.ids) for e in tokenizer.encode_batch(texts, add_special_tokens=False)]


def odd_texts():
    rng = random.Random(3)
    letters = "aaabcdeést'’ \n!1²Σσ漢字éÉ́Ⅷ<|endoftext|>İßſK_'sre'll"
    return ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(1_500)] + [
        "", " ", "it's o'reilly's 'll ''s 'tx '", "a" * 5_000, "ab" * 4_000 + " x", "!" * 3_000 + "'s", "ὈΔΥΣΣΕΎΣ ΣΑΣ", "😀🎉x‍😀",
        "<|endoftext|>a<|startoftext|><|endoftext|> <|EndOfText|>"]


def test_counts_are_those_of_the_library(path, tokenizer):
    texts = odd_texts()
    assert t.Counter(path).count(texts).tolist() == library(tokenizer, texts)


def test_small_chunks_compose(path, tokenizer, monkeypatch):
    monkeypatch.setattr(t, "CHUNK", 5)
    texts = odd_texts()[-400:]
    assert t.Counter(path).count(texts).tolist() == library(tokenizer, texts)


def test_states_are_forgotten_without_harm(path, tokenizer, monkeypatch):
    monkeypatch.setattr(t, "MOST_STATES", 50)
    monkeypatch.setattr(t, "CHARS_AT_ONCE", 200)
    texts = odd_texts()[-200:]
    assert t.Counter(path).count(texts).tolist() == library(tokenizer, texts)


def test_following_tokens_by_definition(path):
    v = t.Vocabulary(path)
    rng = random.Random(5)
    inner = [k for k, s in v.symbols.items() if s[-1] < 256 and len(s) < 5]
    ending = [k for k, s in v.symbols.items() if len(s) < 5]
    for _ in range(3_000):
        a, b = rng.choice(inner), rng.choice(ending)
        if v.spines(a) and v.spines(b):
            assert v.follows(a, b) == ([p[0] for p in v.merged(v.symbols[a] + v.symbols[b])] == [a, b])


def test_rows(spark, path):
    given = [(1, None), (2, ""), (3, "Hello world"), (3, "Hello world"), (None, "é"), (4, "the " * 3_000)]
    got = sorted((tuple(r) for r in t.count_tokens(documents(spark, given), path).collect()), key=repr)
    assert got == sorted([(1, 0, 0, False), (2, 0, 0, False), (3, 11, 2, False), (3, 11, 2, False), (None, 2, 1, False), (4, 12_000, 3_000, True)], key=repr)
    assert t.count_tokens(empty(spark), path).count() == 0


def test_array_dtype(path):
    assert t.Counter(path).count([]).dtype == np.int64


@pytest.mark.parametrize("word", ["a" * 50_000, "abc" * 30_000, "ha" * 20_000 + "h" * 3_001, "thequickbrownfox" * 6_000, "é" * 9_000])
def test_words_over_many_chunks(vocabulary, word):
    """State maps composed over chunks inside one word: forgetful words and periodic ones whose states never settle."""
    from tokenizers import Tokenizer

    path = vocabulary("word_bpe_49k.json")
    texts = [word, f"some {word} more {word[1:]} text"]
    want = [len(Tokenizer.from_file(path).encode(x, add_special_tokens=False).ids) for x in texts]
    assert t.Counter(path).count(texts).tolist() == want


def test_a_long_word_takes_time_in_proportion(vocabulary):
    import random
    import time

    rng = random.Random(3)
    counter = t.Counter(vocabulary("word_bpe_49k.json"))
    unit = "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=20_000))
    counter.count([unit])
    took = []
    for times in (10, 100):
        start = time.perf_counter()
        counter.count([unit * times])
        took.append(time.perf_counter() - start)
    assert took[1] < 10  # 2 million letters; one after the other they took some 25 microseconds each
