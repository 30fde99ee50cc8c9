import random

import numpy as np
import pytest

from linderos.llm import sentencepiece as s

from .conftest import documents, empty


@pytest.fixture(scope="module")
def path(vocabulary):
    return vocabulary("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def pieces(path):
    return s.load_pieces(path)


def texts():
    rng = random.Random(3)
    letters = "aabthe ner in  \n▁é漢字🎉ßé\t"
    return ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(600)] + ["", " ", "x" * 3_000, " " * 50, "▁", "\n\n", "the " * 200]


def ids_of(raw):
    return np.frombuffer(raw, dtype="<i4")


def test_round_trip(pieces):
    codec = s.Codec(pieces)
    assert [codec.decode(ids_of(r)) for r in codec.encode(texts())] == texts()


def brute_score(text, scores, unknown):
    """Best sum of scores over all cuts, on characters and with a plain dictionary."""
    best = [0.0] + [float("-inf")] * len(text)
    for i in range(len(text)):
        for j in range(i + 1, min(len(text), i + 16) + 1):
            if text[i:j] in scores:
                best[j] = max(best[j], best[i] + scores[text[i:j]])
        if text[i] not in scores:
            best[i + 1] = max(best[i + 1], best[i] + unknown)
    return best[-1]


def test_scores_are_the_best_of_all_cuts(pieces):
    byte_ids = set(pieces.byte_ids)
    scores = {d.decode().replace(" ", "▁"): pieces.score[i] for i, d in enumerate(pieces.decoded) if d and i not in byte_ids}
    codec = s.Codec(pieces)
    for text, raw in zip(texts(), codec.encode(texts())):
        if not text or "▁" in text:
            continue
        ids = ids_of(raw).tolist()
        unknown = len(b"".join(pieces.decoded[i] for i in ids if i in byte_ids).decode())
        got = sum(pieces.score[i] for i in ids if i not in byte_ids) + unknown * pieces.unknown
        assert got == pytest.approx(brute_score((" " + text).replace(" ", "▁"), scores, pieces.unknown))


def test_one_and_many_agree(pieces):
    words = [w.encode() for t in texts() for w in t.replace(" ", "▁").split("\n") if 0 < len(w.encode()) <= s.TOGETHER]
    score = lambda ids: sum(pieces.unknown if i < 0 else pieces.score[i] for i in ids)
    for w, many in zip(words, s.cut_many(words, pieces)):
        assert score(many) == pytest.approx(score(s.cut_one(w, pieces)))


def test_double_array_holds_exactly_its_keys():
    keys = [b"a", b"ab", b"abc", b"b", b"\xff", b"ba"]
    base, check, token = s.double_array(keys, list(range(len(keys))))

    def find(key):
        node = 0
        for b in key:
            t = base[node] + b + 1
            if check[t] != node:
                return -1
            node = t
        return token[node]

    assert [find(k) for k in keys] == list(range(len(keys)))
    assert [find(k) for k in (b"c", b"abd", b"bb", b"\xff\xff")] == [-1] * 4


def test_rows(spark, path):
    given = [(1, None), (2, ""), (3, "Hello wörld"), (3, "Hello wörld"), (None, "▁ x"), (4, "word " * 30_000)]
    docs = documents(spark, given)
    back = s.decode_documents(s.encode_documents(docs, path), path)
    want = sorted([(i, t or "") for i, t in given], key=repr)
    assert sorted((tuple(r) for r in back.collect()), key=repr) == want
    trips = s.round_trips(docs, path).collect()
    assert len(trips) == len(given) and all(r["round_trip"] for r in trips)
    assert s.round_trips(empty(spark), path).count() == 0 and s.encode_documents(empty(spark), path).count() == 0
