"""N-gram Jaccard join with Bayesian pruning of candidates (BayesLSH), and groups of near copies.

Two documents are linked if the Jaccard similarity of their sets of five-word shingles is 0.8 or more.

1. Every whole text becomes its shingle set, the set's 128-bit key, and HASHES MinHash values.  Documents with one key
   have one set (copies); they are counted, and one of them stands for all.
2. Candidates share a band of ROWS MinHash values.  A pair at the threshold shares none of the BANDS bands with a
   probability of (1 - 0.8^4)^32, 5e-8.
3. Buckets larger than CELL members are cut into a grid of cells, so that no task holds one whole; cells are streamed in
   sorted order and their pairs never leave the task.  A pair is handled only in the first band it shares.
4. MinHash values are compared STEP at a time.  With a uniform prior, the posterior of similarity s after m matches of n
   is Beta(m + 1, n - m + 1); a pair is dropped when P(s >= 0.8) is below TOLERANCE.
5. Pairs that are left are verified on the exact sets, which are fetched for those documents only.
6. A cell returns, for each of its documents, how many texts and documents it is linked to there, and one edge to the
   smallest key it is connected with in the cell.  Counts add up since every pair is handled once, and the edges connect
   what the links connect; their number grows with the members of cells, not with the pairs.
7. Groups are the connected components of those edges, by label propagation with pointer jumping on Spark.

Words are runs of `\\w`, lower-cased.  Defined results: a text with fewer than five words has one shingle of all its
words; null, empty and wordless texts have no shingles and are copies of each other, linked to nothing else; repeated
rows and ids count as documents of their own; the group id is the smallest doc_id of the group (null if all are null).
Other columns do not matter.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import (
    BinaryType, IntegerType, LongType, StringType, StructField, StructType,
)

from linderos.llm.common import fingerprint, id_type, picked, single, spare_name, with_id, written

SHINGLE = 5
THRESHOLD = 0.8
BANDS, ROWS = 32, 4
HASHES = BANDS * ROWS
STEP = 16
TOLERANCE = 1e-6
CELL = 256
PAIRS_AT_ONCE = 1 << 18
SEED = 7_919

_WORD = re.compile(r"\w+")
_WORDS_CACHED = 200_000
_word_ids: dict[str, int] = {}


def _odd_numbers(count: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 1 << 63, count, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


_MIX = _odd_numbers(SHINGLE, SEED)
_HASHERS = _odd_numbers(HASHES, SEED + 1)


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _ids(words: list[str]) -> np.ndarray:
    if len(_word_ids) > _WORDS_CACHED:
        _word_ids.clear()
    try:
        return np.array([_word_ids[w] for w in words], dtype=np.uint64)
    except KeyError:
        for w in words:
            if w not in _word_ids:
                _word_ids[w] = xxhash.xxh3_64_intdigest(w)
        return np.array([_word_ids[w] for w in words], dtype=np.uint64)


def shingles(text: str | None) -> np.ndarray:
    """The sorted set of 64-bit shingle ids of a whole text."""
    ids = _ids(_WORD.findall((text or "").lower()))
    if not len(ids):
        return ids
    width = min(SHINGLE, len(ids))
    total = np.full(len(ids) - width + 1, width, dtype=np.uint64)
    for k in range(width):
        total += _mixed(ids[k:len(ids) - width + 1 + k] * _MIX[k])
    return np.unique(_mixed(total))


def minhashes(ids: np.ndarray) -> np.ndarray:
    """HASHES unsigned 32-bit minima."""
    least = np.full(HASHES, np.iinfo(np.uint64).max, dtype=np.uint64)
    for i in range(0, len(ids), 4_096):
        np.minimum(least, (_HASHERS[:, None] * ids[None, i:i + 4_096]).min(axis=1), out=least)
    return (least >> np.uint64(32)).astype("<u4")


SKETCH = StructType([
    StructField("doc_id", StringType()), StructField("a", LongType()), StructField("b", LongType()),
    StructField("key", BinaryType()), StructField("n", IntegerType()), StructField("sig", BinaryType()),
])


def _sketch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        keys, sizes, signatures = [], [], []
        for text in pdf.pop("text"):
            ids = shingles(text)
            keys.append(xxhash.xxh3_128_digest(ids.tobytes()))
            sizes.append(len(ids))
            signatures.append(minhashes(ids).tobytes() if len(ids) else b"")
        yield pdf.assign(key=keys, n=sizes, sig=signatures)


def _with_print(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    source = docs.select(F.col(doc_id).cast("string").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    return source.select("doc_id", fingerprint(F.col("text")).alias("p"), "text").select("doc_id", "p.a", "p.b", "text")


def sketches(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, fingerprint (a, b), key, n, sig of every row; written once."""
    found = _with_print(docs, doc_id, text).mapInPandas(_sketch, SKETCH)
    return written(with_id(found, id_type(docs, doc_id)), "sketches")


def distinct_sets(rows: DataFrame) -> DataFrame:
    """One row per key: its copies, smallest doc_id, and a fingerprint of a text that has the set; written once."""
    return written(rows.groupBy("key").agg(
        F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("first_id"), F.min(F.struct("a", "b")).alias("p"),
        F.first("n").alias("n"), F.first("sig").alias("sig"),
    ), "sets")


def bucket_cells(sets: DataFrame, cell: int = CELL) -> DataFrame:
    """band, value, i, j, chunk, key: members of the cells of all buckets with two members or more."""
    bytes_of_band = 4 * ROWS
    values = F.array(*[F.xxhash64(F.lit(b), F.substring("sig", b * bytes_of_band + 1, bytes_of_band)) for b in range(BANDS)])
    places = sets.where(F.col("n") > 0).select("key", F.posexplode(values).alias("band", "value"))
    sizes = places.groupBy("band", "value").agg(F.count(F.lit(1)).alias("members")).where(F.col("members") > 1)
    grid = F.ceil(F.col("members") / cell).cast("int")
    return places.join(sizes, ["band", "value"]).select(
        "band", "value", "key", F.pmod(F.xxhash64("key"), grid).cast("int").alias("chunk"),
        F.explode(F.sequence(F.lit(0), grid - 1)).alias("other"),
    ).select("band", "value", F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"), "chunk", "key")


CELL_ID = ["band", "value", "i", "j"]


def least_matches(threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> dict[int, int]:
    """After n compared values, the fewest matches with which a pair stays.

    P(s >= t) under Beta(m + 1, n - m + 1) is P(Binomial(n + 1, t) <= m).
    """
    least = {}
    for n in range(STEP, HASHES + 1, STEP):
        below = 0.0
        for m in range(n + 1):
            below += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if below >= tolerance:
                least[n] = m
                break
    return least


_LEAST = least_matches()


def pruned(left: np.ndarray, right: np.ndarray, sig: np.ndarray, band: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of rows whose first shared band is this one and that the posterior does not rule out."""
    small, large = np.minimum(n[left], n[right]), np.maximum(n[left], n[right])
    fits = small >= THRESHOLD * large - 1e-9  # similarity is at most small / large
    left, right = left[fits], right[fits]
    wide = sig.view("<u8").reshape(len(sig), BANDS, ROWS // 2)
    shared = np.ones((len(left), BANDS), dtype=bool)
    for k in range(ROWS // 2):
        shared &= wide[left, :, k] == wide[right, :, k]
    own = shared.any(axis=1) & (shared.argmax(axis=1) == band[left])
    left, right = left[own], right[own]
    matches = np.zeros(len(left), dtype=np.int64)
    for start in range(0, HASHES, STEP):
        matches += (sig[left, start:start + STEP] == sig[right, start:start + STEP]).sum(axis=1)
        stays = matches >= _LEAST[start + STEP]
        left, right, matches = left[stays], right[stays], matches[stays]
    return left, right


def verified(left: np.ndarray, right: np.ndarray, sets: list[np.ndarray], n: np.ndarray) -> np.ndarray:
    """Which pairs of rows have similarity of at least the threshold, exactly; `left` is sorted."""
    used = np.unique(np.concatenate([left, right]))
    place = np.full(len(sets), -1)
    place[used] = np.arange(len(used))
    _, flat = np.unique(np.concatenate([sets[u] for u in used]), return_inverse=True)
    ends = np.cumsum(n[used])
    own = [flat[e - s:e] for e, s in zip(ends, n[used])]
    mark = np.zeros(int(flat.max()) + 1, dtype=bool)
    linked = np.zeros(len(left), dtype=bool)
    starts = np.flatnonzero(np.r_[True, left[1:] != left[:-1]])
    for s, e in zip(starts, np.r_[starts[1:], len(left)]):
        mine = own[place[left[s]]]
        mark[mine] = True
        for first in range(s, e, 256):
            some = right[first:min(first + 256, e)]
            others = [own[place[r]] for r in some]
            sizes = np.array([len(o) for o in others])
            common = np.add.reduceat(mark[np.concatenate(others)].astype(np.int64), np.r_[0, np.cumsum(sizes)[:-1]])
            linked[first:first + len(some)] = common >= THRESHOLD * (len(mine) + sizes - common) - 1e-9
        mark[mine] = False
    return linked


def _whole_cells(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The sorted rows again, cut so that no cell is divided."""
    rest: list[pd.DataFrame] = []
    for pdf in batches:
        if not len(pdf):
            continue
        ids = pdf[CELL_ID].to_numpy()
        last = np.flatnonzero((ids != ids[-1]).any(axis=1))
        cut = last[-1] + 1 if len(last) else 0
        if cut or (rest and (rest[-1][CELL_ID].iloc[-1].to_numpy() != ids[0]).any()):
            done = [*rest, pdf.iloc[:cut]]
            rest = []
            yield pd.concat(done, ignore_index=True)
        rest.append(pdf.iloc[cut:])
    if rest:
        yield pd.concat(rest, ignore_index=True)


def _candidate_pairs(pdf: pd.DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of one cell, of different chunks where the cell has two; PAIRS_AT_ONCE or so at a time."""
    ids = pdf[CELL_ID].to_numpy()
    starts = np.flatnonzero(np.r_[True, (ids[1:] != ids[:-1]).any(axis=1)])
    ends = np.repeat(np.r_[starts[1:], len(ids)], np.diff(np.r_[starts, len(ids)]))
    partners = ends - np.arange(len(ids)) - 1
    chunk, diagonal = pdf["chunk"].to_numpy(), (pdf["i"] == pdf["j"]).to_numpy()
    total = np.cumsum(partners)
    at = 0
    while at < len(ids):
        done = total[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(total, done + PAIRS_AT_ONCE)))
        rows = np.arange(at, min(to, len(ids)))
        left = np.repeat(rows, partners[rows])
        right = left + 1 + np.arange(len(left)) - np.repeat(np.cumsum(partners[rows]) - partners[rows], partners[rows])
        keep = diagonal[left] | (chunk[left] != chunk[right])
        yield left[keep], right[keep]
        at = int(rows[-1]) + 1


def _signatures(pdf: pd.DataFrame) -> np.ndarray:
    return np.frombuffer(b"".join(pdf["sig"]), dtype="<u4").reshape(len(pdf), HASHES)


def _survivors(pdf: pd.DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    sig, band, n = _signatures(pdf), pdf["band"].to_numpy(), pdf["n"].to_numpy()
    for left, right in _candidate_pairs(pdf):
        yield pruned(left, right, sig, band, n)


_CELL_FIELDS = [StructField("band", IntegerType()), StructField("value", LongType()), StructField("i", IntegerType()), StructField("j", IntegerType()), StructField("chunk", IntegerType()), StructField("key", BinaryType())]
NEEDED = StructType(_CELL_FIELDS)
LINKS = StructType([StructField("key", BinaryType()), StructField("root", BinaryType()), StructField("texts", LongType()), StructField("docs", LongType())])


def _needed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in _whole_cells(batches):
        stays = np.zeros(len(pdf), dtype=bool)
        for left, right in _survivors(pdf):
            stays[left] = stays[right] = True
        yield pdf.loc[stays, NEEDED.names]


def _roots(size: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The smallest row that each row is connected with."""
    root = np.arange(size)
    while True:
        before = root.copy()
        least = np.minimum(root[left], root[right])
        np.minimum.at(root, left, least)
        np.minimum.at(root, right, least)
        root = root[root]
        if (root == before).all():
            return root


def _links(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in _whole_cells(batches):
        pdf = pdf.sort_values([*CELL_ID, "key"], ignore_index=True)
        sets = [np.frombuffer(s, dtype="<u8") for s in pdf["shingles"]]
        n, copies, keys = pdf["n"].to_numpy(), pdf["copies"].to_numpy(), pdf["key"].to_numpy()
        texts, docs = np.zeros(len(pdf), dtype=np.int64), np.zeros(len(pdf), dtype=np.int64)
        root = np.arange(len(pdf))
        for left, right in _survivors(pdf):
            if not len(left):
                continue
            linked = verified(left, right, sets, n)
            left, right = left[linked], right[linked]
            for x, y in ((left, right), (right, left)):
                np.add.at(texts, x, 1)
                np.add.at(docs, x, copies[y])
            own = _roots(len(pdf), np.r_[left, np.arange(len(pdf))], np.r_[right, root])
            root = np.minimum(root, own)
        has = texts > 0
        yield pd.DataFrame({"key": keys[has], "root": keys[root[has]], "texts": texts[has], "docs": docs[has]})


SHINGLED = StructType([StructField("key", BinaryType()), StructField("shingles", BinaryType())])


def _shingled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        yield pd.DataFrame({"key": pdf["key"], "shingles": [shingles(t).tobytes() for t in pdf["text"]]})


def links(docs: DataFrame, sets: DataFrame, doc_id: str = "doc_id", text: str = "text", cell: int = CELL) -> DataFrame:
    """key, root, texts, docs: for each cell and key, its exact links there; written once."""
    def streamed(rows: DataFrame) -> DataFrame:
        return rows.repartition(*CELL_ID).sortWithinPartitions(*CELL_ID)

    facts = sets.select("key", "n", "sig", "copies")
    members = streamed(bucket_cells(sets, cell).join(facts.drop("copies"), "key"))
    needed = written(members.mapInPandas(_needed, NEEDED), "needed")
    wanted = written(needed.select("key").distinct().join(sets.select("key", "p.a", "p.b"), "key"), "wanted")
    texts = _with_print(docs, doc_id, text).drop("doc_id").join(picked(wanted), ["a", "b"]).groupBy("key").agg(F.first("text").alias("text"))
    shingled = written(texts.mapInPandas(_shingled, SHINGLED), "shingles")
    found = streamed(needed.join(facts, "key").join(shingled, "key"))
    return written(found.mapInPandas(_links, LINKS), "links")


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """node, label: the smallest node of each node's connected component; only nodes that have edges."""
    both = written(
        edges.select(F.col(a).alias("x"), F.col(b).alias("y")).unionAll(edges.select(F.col(b).alias("x"), F.col(a).alias("y")))
        .where(F.col("x") != F.col("y")).distinct(), "edges")
    labels = written(both.groupBy(F.col("x").alias("node")).agg(F.min("y").alias("y")).select("node", F.least("node", "y").alias("label")), "labels")
    while True:
        near = both.join(labels, both.y == labels.node).groupBy("x").agg(F.min("label").alias("m"))
        heard = labels.join(near, labels.node == near.x).select("node", F.col("label").alias("was"), F.least("label", "m").alias("label"))
        far = labels.select(F.col("node").alias("label"), F.col("label").alias("jump"))
        moved = written(heard.join(far, "label").select("node", "was", F.least("label", "jump").alias("label")), "labels")
        changed = single(moved.agg(F.count(F.when(F.col("was") != F.col("label"), 1)).alias("n")))["n"]
        labels = moved.select("node", "label")
        if not changed:
            return labels


def join(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", cell: int = CELL) -> tuple[DataFrame, DataFrame]:
    """(rows, sets): every row with its key, and every key with its group.

    rows: doc_id, a, b, key.  sets: key, copies, first_id, group_key, linked_texts, linked_docs (other sets linked to,
    and the documents that have them).
    """
    rows = sketches(docs, doc_id, text)
    sets = distinct_sets(rows)
    found = links(docs, sets, doc_id, text, cell)
    counts = found.groupBy("key").agg(F.sum("texts").alias("linked_texts"), F.sum("docs").alias("linked_docs"))
    grouped = components(found, "key", "root").select(F.col("node").alias("key"), F.col("label").alias("group_key"))
    joined = sets.select("key", "copies", "first_id").join(counts.join(grouped, "key", "left"), "key", "left")
    zero = F.lit(0).cast("long")
    return rows.select("doc_id", "a", "b", "key"), written(joined.select(
        "key", "copies", "first_id", F.coalesce("group_key", "key").alias("group_key"),
        F.coalesce("linked_texts", zero).alias("linked_texts"), F.coalesce("linked_docs", zero).alias("linked_docs")), "groups")


def near_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", cell: int = CELL) -> DataFrame:
    """doc_id, class_id (smallest doc_id of the group), copy_id (of the documents with the same shingles), n_links
    (documents linked, copies among them), n_linked_texts; one row per row."""
    rows, sets = join(docs, doc_id, text, cell)
    heads = sets.groupBy("group_key").agg(F.min("first_id").alias("class_id"))
    known = sets.join(heads, "group_key").select(
        "key", "class_id", F.col("first_id").alias("copy_id"), (F.col("copies") - 1 + F.col("linked_docs")).alias("n_links"),
        F.col("linked_texts").alias("n_linked_texts"))
    return rows.join(known, "key").select("doc_id", "class_id", "copy_id", "n_links", "n_linked_texts")


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", cell: int = CELL) -> DataFrame:
    """One row of each group: smallest doc_id, then smallest fingerprint; columns unchanged.

    Wordless documents are copies of each other, so one of them stays.
    """
    rows, sets = join(docs, doc_id, text, cell)
    placed = rows.join(sets.select("key", "group_key"), "key")
    order = F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "a", "b")
    best = placed.groupBy("group_key").agg(F.min(order).alias("best"), F.count(F.lit(1)).alias("size")).where(F.col("size") > 1)
    decided = placed.join(best, "group_key").groupBy("doc_id", "a", "b").agg(
        F.max(order == F.col("best")).alias("wins"), F.count(F.lit(1)).alias("rows"))
    decided = written(decided.where(~F.col("wins") | (F.col("rows") > 1)), "decided")
    names = [spare_name(docs, stem) for stem in ("near_id", "near_a", "near_b")]
    i, a, b = names
    shown = fingerprint(F.coalesce(F.col(text).cast("string"), F.lit("")))
    same = F.col(doc_id).cast(id_type(docs, doc_id)).eqNullSafe(F.col(i)) & (shown["a"] == F.col(a)) & (shown["b"] == F.col(b))
    listed = lambda rows: picked(rows.select(F.col("doc_id").alias(i), F.col("a").alias(a), F.col("b").alias(b)))
    kept = docs.join(listed(decided), same, "left_anti")
    repeated = decided.where("wins")
    if single(repeated.agg(F.count(F.lit(1)).alias("n")))["n"]:
        once = docs.join(listed(repeated), same).dropDuplicates(names).select(*docs.columns)
        kept = kept.unionByName(once)
    return kept
