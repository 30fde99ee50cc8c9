import zlib

import numpy as np
import pytest

from linderos.llm import token_file as t

from .conftest import documents, empty

FIRST = [(5, "The quick brown fox"), (1, None), (1, ""), (3, "a  b\n c <|endoftext|> d"), (3, "same"), (3, "same"), (None, "no id"), (9, "word " * 40_000), (4, "漢字 é\n\n x")]


@pytest.fixture(scope="module")
def path(vocabulary):
    return vocabulary("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def tokenizer(path):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def test_pieces_give_the_ids_of_the_library(path, tokenizer):
    import random

    rng = random.Random(1)
    letters = "aabés't ''  \n\n\t12²Σ漢!.,-(_\xa0 <|endoftext|>İKre'll"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) for _ in range(2_000)] + ["", " ", "\n"]
    want = [np.array(e.ids, dtype="<u4").tobytes() for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
    encoder = t.PieceEncoder(path)
    assert encoder.encode(texts) == want and encoder.encode(texts) == want


def want_rows(rows, tokenizer):
    ids = [(i, tokenizer.encode(x or "", add_special_tokens=False).ids + [t.END_ID]) for i, x in rows]
    return [(i, len(x), zlib.crc32(np.array(x, dtype="<u4").tobytes())) for i, x in ids]


@pytest.mark.parametrize("shards", [1, 4])
def test_files_read_back(spark, path, tokenizer, shards):
    folder = t.write_token_file(documents(spark, FIRST), path, shards=shards)
    got = sorted((tuple(r) for r in t.read_digests(spark, folder).collect()), key=lambda r: r[1])
    assert sorted([(i, n, c) for i, _, n, c in got], key=repr) == sorted(want_rows(FIRST, tokenizer), key=repr)
    ids = [-1 if i is None else i for i, *_ in got]
    assert ids == sorted(ids)
    start = 0
    for _, at, n, _ in got:
        assert at == start
        start += n
    assert t.read_document(spark, folder, 5) == [tokenizer.encode(FIRST[0][1]).ids + [0]]
    assert len(t.read_document(spark, folder, 3)) == 3 and t.read_document(spark, folder, 77) == []
    hashes = {r["dict_hash"] for r in t.read_blocks(spark, folder).select("dict_hash").collect()}
    assert hashes == {t.dict_hash(t.read_dictionary(spark, folder))}


def test_trained_dictionary_shrinks_short_documents(spark, path):
    rows = [(i, f"The report number {i} was filed by the office on Monday and sent to the archive of the council {i % 7}.") for i in range(400)]
    dictionary = t.train_dictionary(documents(spark, rows), path)
    raw = t.encoder(path).encode([x for _, x in rows])
    size = lambda d: sum(len(t._compressor(d).compress(r)) for r in raw)
    assert dictionary and size(dictionary) < 0.7 * size(b"")


def test_empty_table(spark, path):
    folder = t.write_token_file(empty(spark), path)
    assert t.read_digests(spark, folder).count() == 0
