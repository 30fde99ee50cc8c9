"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie, with byte fallback.

Encoding.  Blanks become the marker U+2581 and one marker is put before the text.  Of all ways to cut a text into
pieces, Viterbi finds one with the largest sum of log scores.  A character that is no piece by itself may be crossed at
UNKNOWN_PENALTY below the lowest score; it then becomes its UTF-8 bytes, one byte piece each.  A U+2581 that is part of
the text becomes bytes too, so decoding is exact.  The text is not normalised otherwise.

The piece file's scores are merge ranks (0, -1, -2, ...), not log probabilities.  A piece of rank r gets the log score of
Zipf's law, log(1 / ((r + 1) H)), H the sum that makes the scores probabilities; files with real log scores keep theirs.

The trie is a double array over UTF-8 bytes: from node s, byte b leads to t = base[s] + b + 1 if check[t] = s.  It is
built once on the driver and sent to the workers; its size is that of the vocabulary.

If no piece holds a marker behind another character, the best cut of a text is made of the best cuts of its words, and if
none holds a line break, line breaks divide as well; both are looked up in the vocabulary, and texts are cut whole where
they do not hold.  Each worker keeps a
bounded cache of words, and runs Viterbi over all new words of a batch at once, one array operation per place and depth.

Defined results: null text counts as empty; an empty text has no ids; repeated rows are encoded alike; other columns do
not matter.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import (
    ArrayType, BooleanType, IntegerType, LongType, StringType, StructField, StructType,
)

from linderos.llm.common import id_type, with_id

MARKER = "▁"
MARKER_BYTES = MARKER.encode()
UNKNOWN_PENALTY = 10.0
TOGETHER = 48  # words of more bytes are cut one by one
WORDS_AT_ONCE = 20_000
CACHE_WORDS = 400_000


@dataclass(frozen=True)
class Pieces:
    """A vocabulary: log scores, byte pieces, decoded bytes by id, and the double array of its pieces."""

    base: np.ndarray
    check: np.ndarray
    token: np.ndarray  # by node; -1 where no piece ends
    score: np.ndarray  # by id
    byte_ids: list[int]
    decoded: list[bytes]
    lines_divide: bool
    words_divide: bool
    unknown: float


def zipf_scores(ranks: np.ndarray) -> np.ndarray:
    return -np.log((ranks + 1) * np.sum(1.0 / (ranks + 1)))


def double_array(keys: list[bytes], values: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """base, check, token of a double-array trie."""
    children: list[dict[int, int]] = [{}]
    value = [-1]
    for key, v in zip(keys, values):
        node = 0
        for b in key:
            node = children[node].setdefault(b, len(children))
            if node == len(value):
                children.append({})
                value.append(-1)
        value[node] = v
    size = 2 * len(children) + 1_024
    base, check, token = np.zeros(size, dtype=np.int32), np.full(size, -1, dtype=np.int32), np.full(size, -1, dtype=np.int32)
    free = bytearray(b"\x01") * size
    free[0] = 0
    token[0] = value[0]
    first_free = 1
    todo = [(0, 0)]
    while todo:
        node, place = todo.pop()
        codes = sorted(b + 1 for b in children[node])
        if not codes:
            continue
        start = first_free
        while True:
            at = start - codes[0]
            if start + 257 >= len(free):
                grow = len(free)
                free.extend(b"\x01" * grow)
                base, check, token = (np.concatenate([a, np.full(grow, fill, dtype=np.int32)]) for a, fill in ((base, 0), (check, -1), (token, -1)))
            if at >= 0 and all(free[at + c] for c in codes):
                break
            start = free.index(1, start + 1)
        base[place] = at
        for b, child in children[node].items():
            t = at + b + 1
            free[t], check[t], token[t] = 0, place, value[child]
            todo.append((child, t))
        first_free = free.index(1, first_free)
    return np.append(base, np.zeros(257, np.int32)), np.append(check, np.full(257, -1, np.int32)), np.append(token, np.full(257, -1, np.int32))


def load_pieces(path: str) -> Pieces:
    """Read a SentencePiece model file and build its trie."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    size = model.get_piece_size()
    names = [model.id_to_piece(i) for i in range(size)]
    byte_ids, plain, decoded = [0] * 256, [], [b""] * size
    for i, name in enumerate(names):
        if model.is_byte(i):
            value = int(name[1:-1], 16)
            byte_ids[value] = i
            decoded[i] = bytes([value])
        elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
            plain.append(i)
            decoded[i] = name.replace(MARKER, " ").encode()
    given = np.array([model.get_score(i) for i in plain])
    ranks_only = len(given) and given.max() == 0 and (given == np.round(given)).all()
    score = np.zeros(size)
    score[plain] = zipf_scores(-given) if ranks_only else given
    base, check, token = double_array([names[i].encode() for i in plain], plain)
    return Pieces(
        base, check, token, score, byte_ids, decoded,
        lines_divide=not any("\n" in names[i] for i in plain),
        words_divide=not any(MARKER in names[i].lstrip(MARKER) for i in plain),
        unknown=float(score[plain].min()) - UNKNOWN_PENALTY,
    )


def cut_one(raw: bytes, p: Pieces) -> list[int]:
    """Viterbi over one word given as UTF-8 bytes with markers; -1 - n stands for the n bytes of an unknown character."""
    n = len(raw)
    best, back = [-math.inf] * (n + 1), [(0, 0)] * (n + 1)
    best[0] = 0.0
    base, check, token, score = p.base, p.check, p.token, p.score
    for s in range(n):
        if best[s] == -math.inf:
            continue
        lead = raw[s]
        width = 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
        node, alone = 0, False
        for e in range(s, n):
            t = int(base[node]) + raw[e] + 1
            if check[t] != node:
                break
            node = t
            found = int(token[node])
            if found >= 0:
                alone |= e + 1 - s == width
                if (total := best[s] + score[found]) > best[e + 1]:
                    best[e + 1], back[e + 1] = total, (s, found)
        if not alone and (total := best[s] + p.unknown) > best[s + width]:
            best[s + width], back[s + width] = total, (s, -1 - width)
    ids, at = [], n
    while at:
        at, found = back[at]
        ids.append(found)
    return ids[::-1]


def _with_bytes(ids: list[int], raw: bytes, p: Pieces) -> list[int]:
    """The ids with unknown characters replaced by their bytes."""
    out, at = [], 0
    for i in ids:
        if i >= 0:
            out.append(i)
            at += len(p.decoded[i].replace(b" ", MARKER_BYTES))
        else:
            out += [p.byte_ids[b] for b in raw[at:at - 1 - i]]
            at += -1 - i
    return out


def cut_many(words: list[bytes], p: Pieces) -> list[list[int]]:
    """`cut_one` for many words of TOGETHER bytes at most: all words step through the trie at once."""
    count = len(words)
    sizes = np.array([len(w) for w in words])
    longest = int(sizes.max(initial=0))
    raw = np.zeros((count, longest), dtype=np.int32)
    flat = np.frombuffer(b"".join(words), dtype=np.uint8)
    raw[np.arange(longest)[None, :] < sizes[:, None]] = flat
    width = np.where(raw < 0x80, 1, np.where(raw < 0xE0, 2, np.where(raw < 0xF0, 3, 4)))
    best = np.full((count, longest + 5), -np.inf)
    back = np.zeros((count, longest + 5), dtype=np.int32)
    came = np.zeros((count, longest + 5), dtype=np.int32)
    best[:, 0] = 0
    for s in range(longest):
        rows = np.flatnonzero((sizes > s) & (best[:, s] > -np.inf))
        if not len(rows):
            continue
        here, wide, alone = best[rows, s], width[rows, s], np.zeros(len(rows), dtype=bool)
        live, node = np.arange(len(rows)), np.zeros(len(rows), dtype=np.int32)
        for e in range(s, longest):
            live_rows = rows[live]
            inside = sizes[live_rows] > e
            live, node, live_rows = live[inside], node[inside], live_rows[inside]
            t = p.base[node] + raw[live_rows, e] + 1
            on = p.check[t] == node
            live, node, live_rows = live[on], t[on], live_rows[on]
            if not len(live):
                break
            found = p.token[node]
            ends = found >= 0
            alone[live[ends & (wide[live] == e + 1 - s)]] = True
            total = here[live] + p.score[found]
            better = ends & (total > best[live_rows, e + 1])
            at = live_rows[better]
            best[at, e + 1], back[at, e + 1], came[at, e + 1] = total[better], found[better], s
        unknown = np.flatnonzero(~alone)
        at, to = rows[unknown], s + wide[unknown]
        better = here[unknown] + p.unknown > best[at, to]
        at, to, unknown = at[better], to[better], unknown[better]
        best[at, to], back[at, to], came[at, to] = here[unknown] + p.unknown, -1 - wide[unknown], s
    out: list[list[int]] = [[] for _ in range(count)]
    rows, at, steps = np.arange(count), sizes.copy(), []
    while len(rows := rows[at[rows] > 0]):
        steps.append((rows, back[rows, at[rows]]))
        at[rows] = came[rows, at[rows]]
    for some, ids in reversed(steps):
        for r, i in zip(some.tolist(), ids.tolist()):
            out[r].append(i)
    return out


class Codec:
    """Encoding and decoding with a cache of words, one per worker process."""

    def __init__(self, pieces: Pieces) -> None:
        self.p = pieces
        stops = MARKER + ("\n" if pieces.lines_divide else "")
        self.word = re.compile(f" +[^ {stops}]*|[^ {stops}]+|[{stops}]") if pieces.words_divide else re.compile(f"[^{MARKER}]+|{MARKER}")
        self.known: dict[str, bytes] = {MARKER: np.array([pieces.byte_ids[b] for b in MARKER_BYTES], dtype="<i4").tobytes()}
        self.fixed = dict(self.known)
        self.parts: dict[str, bytes] = {}

    def _learn(self, words: list[str]) -> None:
        raw = [w.replace(" ", MARKER).encode() for w in words]
        short = [i for i, r in enumerate(raw) if len(r) <= TOGETHER]
        cut: list[list[int] | None] = [None] * len(raw)
        for first in range(0, len(short), WORDS_AT_ONCE):
            some = short[first:first + WORDS_AT_ONCE]
            for i, ids in zip(some, cut_many([raw[i] for i in some], self.p)):
                cut[i] = ids
        for w, r, ids in zip(words, raw, cut):
            ids = cut_one(r, self.p) if ids is None else ids
            if ids and min(ids) < 0:
                ids = _with_bytes(ids, r, self.p)
            self.known[w] = np.array(ids, dtype="<i4").tobytes()

    def _by_words(self, texts: list[str]) -> list[bytes]:
        words = [self.word.findall(t) for t in texts]
        self._learn(list({w for ws in words for w in ws if w not in self.known}))
        return [b"".join(map(self.known.__getitem__, ws)) for ws in words]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of each text."""
        if len(self.known) + len(self.parts) > CACHE_WORDS:
            self.known, self.parts = dict(self.fixed), {}
        marked = [" " + t if t else "" for t in texts]
        # Without double blanks, the stretches between blanks are words, or words and line breaks.
        plain = [i for i, t in enumerate(marked) if self.p.words_divide and t and "  " not in t]
        stretches = {i: marked[i].split(" ")[1:] for i in plain}
        new = list({s for ss in stretches.values() for s in ss if s not in self.parts})
        self.parts.update(zip(new, self._by_words([" " + s for s in new])))
        rest = [i for i in range(len(texts)) if i not in stretches]
        other = dict(zip(rest, self._by_words([marked[i] for i in rest])))
        get = self.parts.__getitem__
        return [b"".join(map(get, stretches[i])) if i in stretches else other[i] for i in range(len(texts))]

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids; the marker before the text is taken away."""
        return b"".join(map(self.p.decoded.__getitem__, ids.tolist())).decode("utf-8", "replace")[1:]


_codecs: dict[int, Codec] = {}


def codec(pieces: Broadcast) -> Codec:
    """The worker's codec for a vocabulary."""
    key = zlib.crc32(pieces.value.base.tobytes())
    if key not in _codecs:
        _codecs[key] = Codec(pieces.value)
    return _codecs[key]


def send_pieces(spark: SparkSession, path: str) -> Broadcast:
    """The vocabulary of a model file for the workers; a few MB."""
    return spark.sparkContext.broadcast(load_pieces(path))


ENCODED = StructType([StructField("doc_id", StringType()), StructField("ids", ArrayType(IntegerType()))])
ROUND_TRIP = StructType([
    StructField("doc_id", StringType()), StructField("n_chars", LongType()), StructField("n_tokens", LongType()),
    StructField("n_byte_tokens", LongType()), StructField("ids_crc32", LongType()), StructField("round_trip", BooleanType()),
])
ENCODED_AT_ONCE = 500


def _in_slices(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for first in range(0, len(pdf), ENCODED_AT_ONCE):
            yield pdf.iloc[first:first + ENCODED_AT_ONCE]


def _source(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """doc_id and ids of every row; ids that do not decode to their text fail the job."""
    pieces = send_pieces(docs.sparkSession, path)

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in _in_slices(batches):
            worker = codec(pieces)
            ids = [np.frombuffer(raw, dtype="<i4") for raw in worker.encode(pdf["text"].to_list())]
            if any(worker.decode(i) != text for i, text in zip(ids, pdf["text"])):
                raise ValueError("a text did not survive encoding and decoding")
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "ids": ids})

    return with_id(_source(docs).mapInPandas(encode, ENCODED), id_type(docs, "doc_id"))


def decode_documents(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id and text from doc_id and ids."""
    pieces = send_pieces(encoded.sparkSession, path)

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in _in_slices(batches):
            none = np.zeros(0, dtype="<i4")
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "text": [codec(pieces).decode(np.asarray(none if i is None else i)) for i in pdf["ids"]]})

    decoded = encoded.select(F.col("doc_id").cast("string").alias("doc_id"), "ids").mapInPandas(decode, "doc_id string, text string")
    return with_id(decoded, id_type(encoded, "doc_id"))


def round_trips(docs: DataFrame, path: str) -> DataFrame:
    """Every row encoded, decoded from the ids, and compared with its text."""
    pieces = send_pieces(docs.sparkSession, path)

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in _in_slices(batches):
            worker = codec(pieces)
            is_byte = np.zeros(len(worker.p.decoded), dtype=np.int64)
            is_byte[worker.p.byte_ids] = 1
            rows = []
            for doc_id, text, raw in zip(pdf["doc_id"], pdf["text"], worker.encode(pdf["text"].to_list())):
                ids = np.frombuffer(raw, dtype="<i4")
                rows.append((doc_id, len(text), len(ids), int(is_byte[ids].sum()), zlib.crc32(raw), worker.decode(ids) == text))
            yield pd.DataFrame(rows, columns=ROUND_TRIP.names)

    return with_id(_source(docs).mapInPandas(check, ROUND_TRIP), id_type(docs, "doc_id"))
