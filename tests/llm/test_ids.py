"""Ids above 2^53 beside null ones, and ids that are texts, go through every operator unchanged."""

import zlib

import pytest

from linderos.llm import chat, license_scan, near, secrets, sentencepiece, token_counts, token_file

BIG = 1 << 60
IDS = [BIG + 1, None, BIG + 3, BIG + 5]
TEXTS = [f"text number {k} about some things that are not alike at all {k} times {k * 7}" for k in range(4)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(list(zip(IDS, TEXTS)), "doc_id long, text string").coalesce(1)


@pytest.fixture(scope="module")
def named(spark):
    return spark.createDataFrame([("b", TEXTS[0]), (None, TEXTS[1]), ("a", TEXTS[0])], "doc_id string, text string").coalesce(1)


def ids(df, column="doc_id"):
    return sorted((r[column] for r in df.collect()), key=repr)


def test_chat_keeps_conversations_and_turns_apart(spark):
    rows = [(c, t, "user", f"{c} {t}") for c in IDS for t in (BIG + 2, BIG + 1, None)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").coalesce(1)
    formatted = chat.format_conversations(table)
    assert ids(formatted.select("turn").distinct(), "turn") == sorted([None, BIG + 1, BIG + 2], key=repr)
    found = {r["conv_id"]: r for r in chat.conversation_digests(formatted).collect()}
    assert set(found) == set(IDS) and {r["n_turns"] for r in found.values()} == {3}
    import hashlib

    for c in IDS:
        told = "".join(f"user\n{c} {t}\n" for t in (None, BIG + 1, BIG + 2))
        assert found[c]["turns_sha256"] == hashlib.sha256(told.encode()).hexdigest()
    texts = chat.conversation_digests(chat.format_conversations(table.selectExpr("'c' || conv_id as conv_id", "turn", "role", "text")))
    assert ids(texts, "conv_id") == sorted([None if c is None else f"c{c}" for c in IDS], key=repr)


def test_pieces(docs, named, vocabulary):
    path = vocabulary("piece_bpe_32k.model")
    assert ids(sentencepiece.round_trips(docs, path)) == sorted(IDS, key=repr)
    encoded = sentencepiece.encode_documents(docs, path)
    assert ids(encoded) == sorted(IDS, key=repr)
    decoded = {r["doc_id"]: r["text"] for r in sentencepiece.decode_documents(encoded, path).collect()}
    assert decoded == dict(zip(IDS, TEXTS))
    assert ids(sentencepiece.encode_documents(named, path)) == sorted(["a", "b", None], key=repr)


def test_licenses(docs, named):
    model = license_scan.train([["some", "plain", "words", "that", "name", "no", "license"]] * 5)
    assert ids(license_scan.scan_documents(docs, model)) == sorted(IDS, key=repr)
    assert ids(license_scan.scan_documents(named, model)) == sorted(["a", "b", None], key=repr)


def test_token_files(spark, docs, vocabulary):
    path = vocabulary("byte_bpe_50k.json")
    folder = token_file.write_token_file(docs, path)
    found = token_file.read_digests(spark, folder).orderBy("start").collect()
    assert [r["doc_id"] for r in found] == [None, BIG + 1, BIG + 3, BIG + 5]
    assert token_file.read_document(spark, folder, BIG + 3) != token_file.read_document(spark, folder, BIG + 5)


def test_dictionary_is_that_of_the_rows(spark, vocabulary):
    path = vocabulary("byte_bpe_50k.json")
    rows = [(i, f"The report number {i} was filed by the office on Monday and sent to the archive {i % 7}. " * (1 + i % 3)) for i in range(1_500)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    one, other = (token_file.train_dictionary(df, path) for df in (table.coalesce(1), table.orderBy("text").repartition(7)))
    assert one and zlib.crc32(one) == zlib.crc32(other)


def test_near_groups_and_their_keepers(spark, named):
    same = "one text that is the same in all of the rows of this group of copies"
    table = spark.createDataFrame([(BIG + 3, same), (BIG + 1, same), (BIG + 2, same), (None, "x")], "doc_id long, text string").coalesce(1)
    assert sorted(((r["doc_id"], r["class_id"]) for r in near.near_groups(table).collect()), key=repr) == sorted(
        [(BIG + k, BIG + 1) for k in (1, 2, 3)] + [(None, None)], key=repr)
    assert ids(near.keep_one(table)) == sorted([BIG + 1, None], key=repr)
    assert ids(near.keep_one(named)) == sorted(["a", None], key=repr)


def test_operators_that_leave_ids_in_spark(docs, vocabulary):
    assert ids(secrets.scan_documents(docs)) == sorted(IDS, key=repr)
    assert ids(token_counts.count_tokens(docs, vocabulary("word_bpe_49k.json"))) == sorted(IDS, key=repr)


def test_stages(spark, docs):
    import corpus_pipeline

    pytest.importorskip("public_tokenizers")
    wide = docs.selectExpr("doc_id", "text", "'en' as lang", "'s' as source", "length(text) as n_chars")
    kept = corpus_pipeline.near_stage(spark, wide, "")
    assert ids(kept) == sorted(IDS, key=repr) and ids(corpus_pipeline.piece_stage(spark, kept, "")) == sorted(IDS, key=repr)

