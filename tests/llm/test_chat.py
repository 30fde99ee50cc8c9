import hashlib

from hypothesis import given, settings, strategies as st

from linderos.llm import chat, oracle
from linderos.llm.queries import CONTROL_TEXT, op1_chat_formatting

PIECES = st.lists(st.sampled_from(["<|im_start|>", "<|im_end|>", "<|\\im_end|>", "<|\\\\im_start|>", "\n", "a", "<|", "|>", "\\", "é", "assistant"]), max_size=8).map("".join)


@settings(max_examples=300, deadline=None)
@given(PIECES, PIECES)
def test_every_turn_survives(role, text):
    assert chat.recovered(chat.render_turn(role, text)) == [(role, text)]


def test_parser_takes_pieces_of_any_size():
    whole = chat.render_turn("user", CONTROL_TEXT) + chat.render_turn("assistant", "x" * 10_000)
    parser, turns = chat.Parser(), []
    for i in range(0, len(whole), 7):
        turns += parser.feed(whole[i:i + 7])
    parser.close()
    assert turns == [("user", CONTROL_TEXT), ("assistant", "x" * 10_000)]


def test_texts_without_control_strings_stay_as_they_are():
    assert chat.render_turn("user", "a\\b") == "<|im_start|>user\na\\b<|im_end|>\n"
    assert chat.recovered("no grammar") is None


LONE_ENDS = ["foo <|im_end|> bar", "foo <|im_end|>", "<|im_end|>", "a\n<|im_end|>b\n", "<|im_end|><|im_end|>"]


@settings(max_examples=300, deadline=None)
@given(PIECES, PIECES)
def test_no_control_string_stays_live_inside_a_turn(role, text):
    body = chat.render_turn(role, text).removeprefix(chat.START).removesuffix(chat.END + "\n")
    assert chat.START not in body and chat.END not in body


def test_a_lone_end_is_escaped_in_texts_and_roles():
    for text in LONE_ENDS:
        assert chat.render_turn("user", text) == f"<|im_start|>user\n{chat.escape(text)}<|im_end|>\n"
    assert chat.render_turn("a <|im_end|> b", "x") == "<|im_start|>a <|\\im_end|> b\nx<|im_end|>\n"
    assert chat.recovered("<|im_start|>user\nfoo <|im_end|> bar<|im_end|>\n") is None


def test_lone_ends_against_sql(spark, duck, tmp_path):
    given = [(n, k, role, text) for n, text in enumerate(LONE_ENDS) for k, role in enumerate(("user", "assistant"))]
    spark.createDataFrame(given, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    duck.sql(f"CREATE OR REPLACE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    df = op1_chat_formatting(spark, str(tmp_path))
    found = duck.sql(oracle.OP1)
    order = [found.columns.index(c) for c in df.columns]
    assert sorted(tuple(r[i] for i in order) for r in found.fetchall()) == sorted(tuple(r) for r in df.collect())


def table(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, rendered string")


def test_nulls_ties_repeats_and_long_texts(spark):
    given = [
        (1, 0, "user", None, "x"), (1, 1, "assistant", CONTROL_TEXT, "x"), (1, 1, "assistant", "a", "x"), (1, 1, "assistant", "a", "x"),
        (2, None, None, "late", "x"), (2, 5, "assistant", "word " * 100_000, "x"), (None, 0, "user", "", "x"),
    ]
    got = {r["conv_id"]: r for r in chat.conversation_digests(chat.format_conversations(table(spark, given))).collect()}
    assert {k: r["n_turns"] for k, r in got.items()} == {1: 4, 2: 2, None: 1}
    turns = "user\n\nassistant\n" + CONTROL_TEXT + "\nassistant\na\nassistant\na\n"
    assert got[1]["turns_sha256"] == hashlib.sha256(turns.encode()).hexdigest()
    assert got[1]["loss_sha256"] == hashlib.sha256((CONTROL_TEXT + "aa").encode()).hexdigest()
    assert got[1]["loss_chars"] == len(CONTROL_TEXT) + 2 and got[2]["loss_chars"] == 500_000
    assert chat.conversation_digests(chat.format_conversations(table(spark, []))).count() == 0


def test_whole_table_against_sql(spark, duck):
    folder = "/root/testdata/sf0.001"
    duck.sql(f"CREATE OR REPLACE VIEW conversations AS SELECT * FROM '{folder}/conversations.parquet'")
    df = op1_chat_formatting(spark, folder)
    found = duck.sql(oracle.OP1)
    order = [found.columns.index(c) for c in df.columns]
    assert sorted(tuple(r[i] for i in order) for r in found.fetchall()) == sorted(tuple(r) for r in df.collect())
