"""Chat formatting with a grammar round trip.

Grammar of the rendered text (the template):

    conversation := turn*
    turn         := "<|im_start|>" role "\n" content "<|im_end|>" "\n"

Neither role nor content holds a control string: a turn ends at its first "<|im_end|>", wherever in a line that is, and
only a line break may follow it.

A text may hold the control strings itself.  Each turn is rendered, parsed back with the parser of this module and
compared with its source; while they differ, the control strings inside role and content get one backslash after
"<|", which the parser takes away again.  The escape is injective: a control string that already has backslashes gets
one more.  In roles, backslashes and line breaks are escaped as well, since a line break ends the role.

Rendering and its round trip work turn by turn, without a shuffle.  Conversations are then streamed in order: rows are
dealt by conversation, sorted by turn, and parsed from the rendered text with a parser that holds one turn at a time,
so a conversation of any length needs no more memory than its longest turn.  A SHA-256 over a conversation is
sequential by nature, so its bytes pass through one task; only rendered text does, the rendering itself is spread.

Defined results: null role or text counts as empty; rows without conv_id form one conversation; rows with equal turn
are ordered by role, then text; a null turn comes first; repeated rows are repeated turns; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from linderos.llm.common import id_type, with_id

START, END = "<|im_start|>", "<|im_end|>"
LEARNT_ROLE = "assistant"

_CONTROL = re.compile(r"<\|(\\*)(im_start|im_end)\|>")
_ESCAPED = re.compile(r"<\|\\(\\*)(im_start|im_end)\|>")

TURN_SCHEMA = StructType([
    StructField("conv_id", StringType()), StructField("turn", StringType()), StructField("role", StringType()),
    StructField("text", StringType()), StructField("rendered", StringType()),
])
DIGEST_SCHEMA = StructType([
    StructField("conv_id", StringType()), StructField("n_turns", LongType()), StructField("turns_sha256", StringType()),
    StructField("loss_chars", LongType()), StructField("loss_sha256", StringType()),
    StructField("formatted_chars", LongType()), StructField("n_escaped_turns", LongType()),
])


def escape(text: str) -> str:
    return _CONTROL.sub(r"<|\\\1\2|>", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<|\1\2|>", text)


def escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(\\|n)", lambda m: "\n" if m[1] == "n" else "\\", unescape(role))


class Parser:
    """Deterministic parser of the grammar above, fed in pieces; keeps what is not yet a whole turn."""

    def __init__(self) -> None:
        self._rest = ""

    def feed(self, piece: str) -> Iterator[tuple[str, str]]:
        self._rest += piece
        at = 0
        # A turn ends at END itself; what comes behind it must be known before the turn is judged.
        while 0 <= (end := self._rest.find(END, at)) < len(self._rest) - len(END):
            if not self._rest.startswith(START, at):
                raise ValueError("a turn must begin with " + START)
            body = self._rest[at + len(START):end]
            role, line_break, content = body.partition("\n")
            if not line_break or START in body or self._rest[end + len(END)] != "\n":
                raise ValueError("malformed turn")
            yield unescape_role(role), unescape(content)
            at = end + len(END) + 1
        self._rest = self._rest[at:]

    def close(self) -> None:
        if self._rest:
            raise ValueError("text after the last turn")


def recovered(rendered: str) -> list[tuple[str, str]] | None:
    """The turns of a rendered text, or None where it is not in the grammar."""
    parser = Parser()
    try:
        turns = list(parser.feed(rendered))
        parser.close()
    except ValueError:
        return None
    return turns


def render_turn(role: str, text: str) -> str:
    """Render one turn; escape what the parser does not give back as it was, until it does."""
    source = [(role, text)]
    shown_role, shown_text = role, text
    for escape_text, escape_name in ((False, False), (True, False), (True, True)):
        shown_text = escape(text) if escape_text else text
        shown_role = escape_role(role) if escape_name else role
        rendered = f"{START}{shown_role}\n{shown_text}{END}\n"
        if recovered(rendered) == source:
            return rendered
    raise AssertionError("the fully escaped form must parse back")


def render(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        pdf["rendered"] = [render_turn(role, text) for role, text in zip(pdf["role"], pdf["text"])]
        yield pdf


def render_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and the rendered turn, one row per row of the table; no shuffle."""
    rows = conversations.select(
        F.col("conv_id").cast("string").alias("conv_id"), F.col("turn").cast("long").cast("string").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    return with_id(rows.mapInPandas(render, TURN_SCHEMA), id_type(conversations, "conv_id"), "conv_id").withColumn("turn", F.col("turn").cast("long"))


class _Conversation:
    """Figures of one conversation, gathered from its rendered text turn by turn."""

    def __init__(self, conv_id: str | None) -> None:
        self.conv_id, self.parser = conv_id, Parser()
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()
        self.n_turns = self.loss_chars = self.formatted_chars = self.escaped = 0

    def add(self, rendered: str) -> None:
        self.formatted_chars += len(rendered)
        for role, text in self.parser.feed(rendered):
            self.n_turns += 1
            self.turns.update(f"{role}\n{text}\n".encode())
            self.escaped += len(rendered) != len(START) + len(role) + 1 + len(text) + len(END) + 1
            if role == LEARNT_ROLE:
                self.loss_chars += len(text)
                self.loss.update(text.encode())

    def row(self) -> tuple:
        self.parser.close()
        return (self.conv_id, self.n_turns, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(),
                self.formatted_chars, self.escaped)


def read_back(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = DIGEST_SCHEMA.names
    current: _Conversation | None = None
    for pdf in batches:
        done = []
        for conv_id, rendered in zip(pdf["conv_id"], pdf["rendered"]):
            if current is None or current.conv_id != conv_id:
                if current is not None:
                    done.append(current.row())
                current = _Conversation(conv_id)
            current.add(rendered)
        yield pd.DataFrame(done, columns=names)
    if current is not None:
        yield pd.DataFrame([current.row()], columns=names)


def ordered_turns(rendered: DataFrame) -> DataFrame:
    """The formatted corpus: rendered turns, each conversation whole in one partition and in order."""
    order = [F.asc_nulls_first(c) for c in ("conv_id", "turn", "role", "text")]
    return rendered.repartition("conv_id").sortWithinPartitions(*order)


def conversation_digests(ordered: DataFrame) -> DataFrame:
    """One row per conversation, read back from the formatted corpus."""
    digests = ordered.select(F.col("conv_id").cast("string"), "rendered").mapInPandas(read_back, DIGEST_SCHEMA)
    return with_id(digests, id_type(ordered, "conv_id"), "conv_id")


def format_conversations(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, rendered: the formatted corpus.  Joining `rendered` in order gives the text."""
    return ordered_turns(render_turns(conversations))
