"""Token-ID files with a shared zstandard dictionary.

Format: a table of blocks on the session's shared storage, written by Spark, so that a lost or repeated task leaves no
half file.  A block holds consecutive documents of one shard:

    shard, block     place of the block; shards are ranges of doc_id in ascending order
    shard_start      tokens of the shard before this block
    dict_hash        first 16 hex digits of the SHA-256 of the dictionary the frames need
    doc_ids          ids of the documents, in order
    counts           tokens of each document
    offsets          start of each document's frame in `payload`, and the end of the last
    n_tokens         tokens of the block
    payload          zstandard frames, one per document: little-endian unsigned 32-bit ids

The dictionary lies beside the blocks, named by its hash.  One short document is read by its block's offset index and
one frame, without touching its neighbours (`read_document`).

Documents are dealt by ranges of (doc_id, fingerprint of the text), so many rows of one id spread over shards; order
among rows of equal id is that of the fingerprint.  The dictionary is trained on DICT_SAMPLE_CHARS at most, from anywhere
in the text, of DICT_SAMPLE documents at most, chosen by a hash of the id over the whole table (of rows with one id by a
hash of the text): the same rows give the same dictionary however they are stored.  The bounds only affect sizes, never content.

Encoding: the tokenizer cuts text into independent pieces at blanks (`cut_text`), so each worker asks the library for a
distinct piece once and looks it up afterwards (a cache bounded in pieces and in bytes).  New pieces are asked as one
text, whose ids are dealt out by the bytes they stand for.  Texts with a special string are encoded whole.

Defined results: null text is empty; an empty document has the end id alone; rows without doc_id come first; ids are longs; repeated
rows are repeated; an empty table gives an empty file.
"""

from __future__ import annotations

import hashlib
import os
import re
import zlib
from collections.abc import Callable, Iterator
from itertools import compress

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import (
    ArrayType, BinaryType, IntegerType, LongType, StringType, StructField, StructType,
)

from linderos.llm.common import fingerprint, fresh_path, largest_of_smallest

END_ID = 0
DICT_BYTES = 112_640
DICT_SAMPLE = 1_000
DICT_SAMPLE_CHARS = 8_192
LEVEL = 3
BLOCK_TOKENS = 1 << 20
CACHE_PIECES, CACHE_BYTES = 1_500_000, 96 << 20  # with what Python adds, some 300 MB
LONGEST_KEPT = 256
MARKS = ".,;:!?"
LATIN_END = "\u0250"  # below it, letters are the same to Python and to the tokenizer
ASKED_AT_ONCE = 4_000
ENCODED_AT_ONCE = 500

BLOCK_SCHEMA = StructType([
    StructField("shard", IntegerType()), StructField("block", IntegerType()),
    StructField("shard_start", LongType()), StructField("dict_hash", StringType()),
    StructField("doc_ids", ArrayType(LongType())), StructField("counts", ArrayType(LongType())),
    StructField("offsets", ArrayType(LongType())), StructField("n_tokens", LongType()),
    StructField("payload", BinaryType()),
])

_CUT = re.compile(r"(?<=\S) (?=\S)")
_BETWEEN = re.compile(r"\s \s")
# Blanks between two of the usual white-space characters.
_USUAL_BETWEEN = [f"{a} {b}" for a in " \n\t" for b in " \n\t"]


def cut_text(text: str) -> list[str]:
    """The text cut at its blanks; the pieces but the first, each with a blank before it, are encoded as in the text.

    The tokenizer begins a new part where white space begins, and at the last blank before another character.  So every
    blank is a place to cut unless white space is on both sides of it; a text with such blanks is cut at those between
    two other characters only.
    """
    if text.replace("\n", "").replace("\t", "").isprintable():  # no other white space
        whole = not any(p in text for p in _USUAL_BETWEEN)
    else:
        whole = _BETWEEN.search(text) is None
    return text.split(" ") if whole else _CUT.split(text)


class PieceEncoder:
    """Encodes texts with a byte-level tokenizer through a cache of their pieces; the ids are those of the library."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core; the library's threads would spin
        self.tokenizer = Tokenizer.from_file(path)
        self.specials = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        # Bytes that each id stands for: a byte-level vocabulary writes one letter a byte.
        names = self.tokenizer.get_vocab(with_added_tokens=True)
        self.sizes = np.zeros(max(names.values()) + 1, dtype=np.int64)
        for name, token in names.items():
            self.sizes[token] = len(name)
        self.pieces: dict[str, bytes] = {}  # a piece between two blanks, encoded with the blank before it
        self.firsts: dict[str, bytes] = {}  # a first piece, without a blank
        self.kept_bytes = 0
        self.marks = dict(zip(MARKS, self._whole(list(MARKS))))

    def _whole(self, texts: list[str]) -> list[bytes]:
        encoded = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, dtype="<u4").tobytes() for e in encoded]

    def _dealt(self, pieces: list[str]) -> list[bytes]:
        """Ids of each piece with a blank before it; none ends in white space, so they are encoded as one text."""
        (encoded,) = self.tokenizer.encode_batch_fast([" " + " ".join(pieces)], add_special_tokens=False)
        ids = np.array(encoded.ids, dtype="<u4")
        ends = np.cumsum([1 + len(p.encode()) for p in pieces])
        reached = np.cumsum(self.sizes[ids])
        last = np.searchsorted(reached, ends)
        if len(reached) <= last[-1] or (reached[last] != ends).any():
            return self._whole([" " + p for p in pieces])
        raw, cuts = ids.tobytes(), [0, *(4 * (last + 1)).tolist()]
        self.kept_bytes += len(raw) + int(ends[-1])
        return [raw[a:b] for a, b in zip(cuts, cuts[1:])]

    def _learn(self, pieces: set[str]) -> None:
        """A word and a mark behind it are two parts to the tokenizer, so only the word is asked."""
        asked, marked, alone = set(), [], []
        for p in pieces:
            if not p or p[0].isspace() or p[-1].isspace():
                alone.append(p)
            elif p[-1] in MARKS and p[:-1].isalpha() and max(p) < LATIN_END:
                marked.append(p)
                if p[:-1] not in self.pieces:
                    asked.add(p[:-1])
            else:
                asked.add(p)
        listed = list(asked)
        for i in range(0, len(listed), ASKED_AT_ONCE):
            some = listed[i:i + ASKED_AT_ONCE]
            self.pieces.update(zip(some, self._dealt(some)))
        known, ends = self.pieces, self.marks
        known.update([(p, known[p[:-1]] + ends[p[-1]]) for p in marked])
        known.update(zip(alone, self._whole([" " + p for p in alone])))

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        if len(self.pieces) > CACHE_PIECES or self.kept_bytes > CACHE_BYTES:
            self.pieces.clear()
            self.firsts.clear()
            self.kept_bytes = 0
        out: list[bytes] = [b""] * len(texts)
        special = [any(s in text for s in self.specials) for text in texts]
        alone = list(compress(range(len(texts)), special))
        for i, ids in zip(alone, self._whole([texts[i] for i in alone])):
            out[i] = ids
        usual = [i for i, (text, whole) in enumerate(zip(texts, special)) if text and not whole]
        cut, found, new = {}, {}, set()
        get = self.pieces.get
        for i in usual:
            cut[i] = pieces = cut_text(texts[i])
            ids = list(map(get, pieces))
            ids[0] = b""  # the first piece has no blank before it
            if None in ids:
                new.update(compress(pieces, [known is None for known in ids]))
            found[i] = ids
        self._learn(new)
        known = self.pieces.__getitem__
        opening = list({cut[i][0] for i in usual}.difference(self.firsts))
        self.firsts.update(zip(opening, self._whole(opening)))
        self.kept_bytes += sum(map(len, opening))
        for i in usual:
            first, ids = self.firsts[cut[i][0]], found[i]
            if None in ids:
                ids = [known(p) if own is None else own for p, own in zip(cut[i], ids)]
            out[i] = first + b"".join(ids)
        for kept, some in ((self.pieces, new), (self.firsts, opening)):
            for p in [p for p in some if len(p) > LONGEST_KEPT]:
                del kept[p]  # a line without blanks will hardly come again
        return out


_encoders: dict[str, PieceEncoder] = {}


def encoder(path: str) -> PieceEncoder:
    """One per worker process."""
    if path not in _encoders:
        _encoders[path] = PieceEncoder(path)
    return _encoders[path]


def dict_hash(dictionary: bytes) -> str:
    return hashlib.sha256(dictionary).hexdigest()[:16]


def train_dictionary(docs: DataFrame, path: str) -> bytes:
    """A zstandard dictionary from serialized ids of a bounded sample; empty where there is too little to train on."""
    keyed = docs.where(F.col("doc_id").isNotNull()).select(F.xxhash64("doc_id").alias("key"), "text")
    last = F.lit(largest_of_smallest(keyed, DICT_SAMPLE)).cast("long")
    spare = F.greatest(F.length("text") - DICT_SAMPLE_CHARS, F.lit(0)) + 1
    cut = F.substring("text", F.pmod("key", spare).cast("int") + 1, F.lit(DICT_SAMPLE_CHARS))
    some = keyed.where((F.col("key") <= last) & F.col("text").isNotNull()).select("key", F.struct(F.xxhash64("text").alias("h"), cut.alias("text")).alias("s"))
    rows = some.groupBy("key").agg(F.min("s").alias("s")).select("key", "s.text").orderBy("key").collect()
    end = np.asarray([END_ID], dtype="<u4").tobytes()
    samples = [ids + end for ids in encoder(path).encode([r["text"] or "" for r in rows])]
    try:
        return zstandard.train_dictionary(DICT_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return b""


def _compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    shared = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    if shared:
        shared.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=shared, write_content_size=True)


def _decompressor(dictionary: bytes) -> zstandard.ZstdDecompressor:
    return zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)


class _Block:
    def __init__(self) -> None:
        self.doc_ids, self.counts, self.offsets, self.payload = [], [], [0], []

    def add(self, doc_id: int | None, count: int, frame: bytes) -> None:
        self.doc_ids.append(doc_id)
        self.counts.append(count)
        self.offsets.append(self.offsets[-1] + len(frame))
        self.payload.append(frame)

    def row(self, shard: int, block: int, shard_start: int, name: str) -> tuple:
        return (shard, block, shard_start, name, self.doc_ids, self.counts, self.offsets, sum(self.counts), b"".join(self.payload))


def write_blocks(dictionary: bytes, path: str) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    name = dict_hash(dictionary)
    end = np.asarray([END_ID], dtype="<u4").tobytes()

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        compressor = _compressor(dictionary)
        block, number, tokens, done, shard = _Block(), 0, 0, 0, 0
        for pdf in batches:
            shard = int(pdf["shard"].iloc[0]) if len(pdf) else shard
            full = []
            for first in range(0, len(pdf), ENCODED_AT_ONCE):
                some = pdf.iloc[first:first + ENCODED_AT_ONCE]
                encoded = encoder(path).encode([t or "" for t in some["text"]])
                for doc_id, ids in zip(some["doc_id"], encoded):
                    ids += end
                    block.add(doc_id if doc_id is None else int(doc_id), len(ids) // 4, compressor.compress(ids))
                    tokens += len(ids) // 4
                    if tokens >= BLOCK_TOKENS:
                        full.append(block.row(shard, number, done, name))
                        block, number, tokens, done = _Block(), number + 1, 0, done + tokens
            if full:
                yield pd.DataFrame(full, columns=BLOCK_SCHEMA.names)
        if block.doc_ids:
            yield pd.DataFrame([block.row(shard, number, done, name)], columns=BLOCK_SCHEMA.names)

    return write


def write_token_file(docs: DataFrame, tokenizer_path: str, folder: str | None = None, shards: int | None = None) -> str:
    """Encode doc_id, text and write the blocks; returns the folder."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    folder = folder or fresh_path(spark, "tokens")
    dictionary = train_dictionary(docs, tokenizer_path)
    name = dict_hash(dictionary)
    spark.createDataFrame([(name, bytearray(dictionary))], "dict_hash string, dictionary binary").write.parquet(f"{folder}/dictionary")
    order = [F.asc_nulls_first("doc_id"), F.asc("print")]
    keyed = docs.withColumn("print", fingerprint(F.col("text")))
    dealt = keyed.repartitionByRange(shards, *order) if shards else keyed.repartitionByRange(*order)
    ordered = dealt.sortWithinPartitions(*order).select(F.col("doc_id").cast("string"), "text", F.spark_partition_id().alias("shard"))
    blocks = ordered.mapInPandas(write_blocks(dictionary, tokenizer_path), BLOCK_SCHEMA)
    blocks.write.option("compression", "uncompressed").parquet(f"{folder}/blocks")
    return folder


def read_blocks(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(BLOCK_SCHEMA).parquet(f"{folder}/blocks")


def read_dictionary(spark: SparkSession, folder: str) -> bytes:
    row = spark.read.parquet(f"{folder}/dictionary").first()
    if dict_hash(bytes(row["dictionary"])) != row["dict_hash"]:
        raise ValueError("the dictionary does not match its hash")
    return bytes(row["dictionary"])


def located_blocks(spark: SparkSession, folder: str) -> DataFrame:
    """Blocks with `start`, the tokens of all blocks before them.

    A block knows the tokens before it in its shard; the driver adds up one number per shard, as many as the write had
    partitions, and that list is broadcast.
    """
    blocks = read_blocks(spark, folder)
    totals = sorted((r["shard"], r["n"]) for r in blocks.groupBy("shard").agg(F.sum("n_tokens").alias("n")).collect())
    before, bases = 0, []
    for shard, n in totals:
        bases.append((shard, before))
        before += n
    base = spark.createDataFrame(bases, "shard int, base long")
    return blocks.join(F.broadcast(base), "shard").withColumn("start", F.col("base") + F.col("shard_start"))


def frames(doc_ids: list, counts: list, offsets: list, payload: bytes, decompressor: zstandard.ZstdDecompressor) -> Iterator[tuple]:
    """(doc_id, count, ids) of each document of a block; checks the counts."""
    for k, (doc_id, count) in enumerate(zip(doc_ids, counts)):
        ids = decompressor.decompress(payload[offsets[k]:offsets[k + 1]])
        if len(ids) != 4 * count:
            raise ValueError("a frame does not hold the number of ids in its index")
        yield doc_id, count, ids


def read_digests(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files."""
    dictionary = read_dictionary(spark, folder)
    name = dict_hash(dictionary)

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        decompressor = _decompressor(dictionary)
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                if r.dict_hash != name:
                    raise ValueError("a block needs another dictionary")
                rows, start = [], r.start
                for doc_id, count, raw in frames(r.doc_ids, r.counts, r.offsets, r.payload, decompressor):
                    rows.append((doc_id, start, count, zlib.crc32(raw)))
                    start += count
                yield pd.DataFrame(rows, columns=["doc_id", "start", "n_tokens", "ids_crc32"])

    blocks = located_blocks(spark, folder).withColumn("doc_ids", F.transform("doc_ids", lambda d: d.cast("string")))
    found = blocks.mapInPandas(read, "doc_id string, start long, n_tokens long, ids_crc32 long")
    return found.withColumn("doc_id", F.col("doc_id").cast("long"))


def read_document(spark: SparkSession, folder: str, doc_id: int) -> list[list[int]]:
    """The ids of the documents with this id, from their frames alone."""
    decompressor = _decompressor(read_dictionary(spark, folder))
    at = F.array_position("doc_ids", F.lit(doc_id))
    found = []
    for r in read_blocks(spark, folder).where(at > 0).select("doc_ids", "counts", "offsets", "payload").collect():
        for k, d in enumerate(r["doc_ids"]):
            if d == doc_id:
                raw = decompressor.decompress(bytes(r["payload"][r["offsets"][k]:r["offsets"][k + 1]]))
                found.append(np.frombuffer(raw, dtype="<u4").tolist())
    return found
