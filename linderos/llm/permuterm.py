"""Spelling variants of words by permuterm rotations.

1. Words are counted inside tasks, then over all documents (partial sums first, so a frequent word moves once a task).
2. Every word w is marked as w$.  Its rotations are b$a for each cut w = ab.  Leaving the character after the cut out of
   the rotation gives a key b$a for w = acb, the prefix that all words acb with any c share; a word ab that lacks the
   character has the key as a whole rotation.  So two words are near exactly if they meet under a key: both skip a
   character (replaced), or one skips and the other is whole (inserted or deleted).
3. Rotations are dealt by key and sorted; each run of equal keys is scanned and tells each of its words how many near
   words it met and the best of them.  A key has one word per character and one whole word, so at most 91 members,
   however large the table.  A pair that differs in a replaced character meets once; where a character is left out of a
   run of equal ones, only the first of the run counts, so an inserted or deleted one meets once too.
4. A word is rebuilt from its rotation, so that key, character and count are all that moves.  Rotations of over LITERAL
   code points are replaced by a digest (a polynomial in a prime field of 127 bits, linear in the length for all
   rotations of a word); their pairs are few, are joined with the words and counted there.
5. Forms lead to ever more frequent words (ten times each step), so pointer doubling finds the last of each chain in a
   few rounds.

Defined results: null and empty texts have no words; a null id reads as the empty text; documents that are repeated
count as often as they are there; an empty table, or one without repeated words, gives no rows; other columns do not
matter.  Whole texts are read; batches and worker tables are bounded by KEPT_WORDS and KEPT_CHARACTERS.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, functions as F

from linderos.llm.common import single, written

SHORTEST = 7
OCCURRENCES = 2
DAMAGE = 31
RATIO = 10
LITERAL = 64
KEPT_WORDS = 200_000
KEPT_CHARACTERS = 1 << 24
SCANNED = 1 << 15

_RUN = re.compile(rf"[a-zÀ-ÿ]{{{SHORTEST},}}")
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_PRIME = (1 << 127) - 1
_BASE = 0x1F3D5B79A6C8E0F24D1B3A5978695A4B
END = "$"

Batches = Iterator[pa.RecordBatch]


def words_of(doc_id: str, text: str) -> Counter[str]:
    """Words of one text after its damage: of runs whose checksum DAMAGE divides, one code point is deleted."""
    runs = Counter(_RUN.findall(text.encode().translate(_LOWER).decode()))
    start = zlib.crc32(f"{doc_id}:".encode())
    found: Counter[str] = Counter()
    for run, n in runs.items():
        h = zlib.crc32(run.encode(), start)
        if h % DAMAGE == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1:]
            if len(run) < SHORTEST:
                continue
        found[run] += n
    return found


def _counted(batches: Batches) -> Batches:
    def shown(counts: Counter[str]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])

    counts: Counter[str] = Counter()
    characters = 0
    for batch in batches:
        for doc_id, text in zip(batch.column(0), batch.column(1)):
            if text.is_valid:
                for word, n in words_of(doc_id.as_py() or "", text.as_py()).items():
                    if word not in counts:
                        characters += len(word)
                    counts[word] += n
                if len(counts) > KEPT_WORDS or characters > KEPT_CHARACTERS:
                    yield shown(counts)
                    counts, characters = Counter(), 0
    yield shown(counts)


def word_counts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """word, n: the words of OCCURRENCES or more; written once."""
    given = docs.select(F.col(doc_id).cast("string"), F.col(text).cast("string"))
    partial = given.mapInArrow(_counted, "word string, n long")
    return written(partial.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= OCCURRENCES), "words")


def literal_rotations(words: DataFrame) -> DataFrame:
    """key, skipped (empty: whole rotation), n: every rotation of at most LITERAL code points, dealt and sorted by key.

    One text a row is shuffled; it is taken apart afterwards.
    """
    w, length = F.col("word"), F.length("word")
    short = words.where(length <= LITERAL)
    places = short.select("word", "n", F.explode(F.sequence(F.lit(0), 2 * length)).alias("p"))
    whole = F.col("p") <= length
    cut = F.when(whole, F.col("p")).otherwise(F.col("p") - length - 1)
    skipped = F.when(whole, F.lit("")).otherwise(F.substring(w, cut + 1, F.lit(1)))
    after = F.substring(w, cut + F.when(whole, 1).otherwise(2), length)
    key = F.concat(after, F.lit(END), F.substring(w, F.lit(1), cut))
    rows = places.where(~whole | (length < LITERAL)).select(F.concat_ws("\t", key, skipped, F.col("n").cast("string")).alias("row"))
    dealt = rows.repartition(F.substring_index("row", "\t", 1)).sortWithinPartitions("row")
    part = F.split("row", "\t")
    return dealt.select(part[0].alias("key"), part[1].alias("skipped"), part[2].cast("long").alias("n"))


def _gathered(batches: Batches) -> Iterator[pa.Table]:
    """Batches put together to SCANNED rows or more."""
    some: list[pa.RecordBatch] = []
    for batch in batches:
        some.append(batch)
        if sum(map(len, some)) >= SCANNED:
            yield pa.Table.from_batches(some)
            some = []
    if some:
        yield pa.Table.from_batches(some)


def _runs(batches: Batches) -> Iterator[tuple[str, list[dict]]]:
    """Runs of two or more rows with one key, from rows sorted by key; a run may go over batches."""
    rest: pa.Table | None = None
    for table in _gathered(batches):
        table = (pa.concat_tables([rest, table]) if rest is not None else table).combine_chunks()
        if not len(table):
            continue
        key = table.column("key")
        change = pc.not_equal(key.slice(1), key.slice(0, len(key) - 1)).to_numpy()
        last = int(np.flatnonzero(change)[-1]) + 1 if change.any() else 0
        yield from _several(table.slice(0, last), change[:last])
        rest = table.slice(last)
    if rest is not None and len(rest):
        key = rest.column("key")
        yield from _several(rest, np.append(pc.not_equal(key.slice(1), key.slice(0, len(key) - 1)).to_numpy(), True))


def _several(table: pa.Table, ends: np.ndarray) -> Iterator[tuple[str, list[dict]]]:
    """`ends` tells for each row whether the next has another key."""
    if not len(table):
        return
    alone = ends & np.append(True, ends[:-1])
    rows = table.filter(pa.array(~alone)).to_pylist()
    at = 0
    while at < len(rows):
        key, first = rows[at]["key"], at
        while at < len(rows) and rows[at]["key"] == key:
            at += 1
        yield key, rows[first:at]


def _rebuilt(key: str, skipped: str) -> str:
    after, before = key.split(END)
    return before + skipped + after


def _met(batches: Batches) -> Batches:
    """word, n_near, form_n, form: what each word meets under one key."""
    out: list[tuple[str, int, int, str]] = []

    def shown() -> pa.RecordBatch:
        columns = list(zip(*out)) or [(), (), (), ()]
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["word", "n_near", "form_n", "form"])

    for key, rows in _runs(batches):
        skips = [(-r["n"], _rebuilt(key, r["skipped"]), r["skipped"] != key[-1]) for r in rows if r["skipped"]]
        whole = [(-r["n"], _rebuilt(key, "")) for r in rows if not r["skipped"]]
        ranked = sorted(skips)[:2]
        for entry in skips:
            others = len(skips) - 1 + (len(whole) if entry[2] else 0)
            if others:
                best = min([o[:2] for o in ranked if o[1] != entry[1]] + (whole if entry[2] else []))
                out.append((entry[1], others, -best[0], best[1]))
        counting = [s[:2] for s in skips if s[2]]
        if whole and counting:
            best = min(counting)
            out.append((whole[0][1], len(counting), -best[0], best[1]))
        if len(out) > 10_000:
            yield shown()
            out.clear()
    yield shown()


def digests(word: str) -> tuple[list[int], list[int]]:
    """Of all rotations of the marked word: those without the character after the cut, and the whole ones."""
    size = len(word)
    heads, powers = [0], [1]
    for c in word:
        heads.append((heads[-1] * _BASE + ord(c)) % _PRIME)
        powers.append(powers[-1] * _BASE % _PRIME)
    powers.append(powers[-1] * _BASE % _PRIME)

    def rotation(cut: int, start: int) -> int:
        after = heads[size] - heads[start] * powers[size - start]
        return ((after * _BASE + ord(END)) * powers[cut] + heads[cut]) % _PRIME

    return [rotation(k, k + 1) for k in range(size)], [rotation(k, k) for k in range(size + 1)]


def _name(word: str) -> str:
    return xxhash.xxh3_128_hexdigest(word.encode())


def _long_rotations(batches: Batches) -> Batches:
    """key, name, skipped (empty: whole), first (of a run of equal characters): rotations of over LITERAL code points."""
    for batch in batches:
        for word in batch.column(0).to_pylist():
            name = _name(word)
            skips, whole = digests(word) if len(word) > LITERAL else ([], digests(word)[1])
            rows = [(f"{d:x}", name, word[k], k == 0 or word[k - 1] != word[k]) for k, d in enumerate(skips)]
            rows += [(f"{d:x}", name, "", True) for d in whole]
            for at in range(0, len(rows), 100_000):
                columns = zip(zip(*rows[at:at + 100_000]), (pa.string(), pa.string(), pa.string(), pa.bool_()))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in columns], ["key", "name", "skipped", "first"])


def _long_pairs(batches: Batches) -> Batches:
    """name, near: both ways, for each pair that meets under a key; a key has 91 members at most."""
    for _, rows in _runs(batches):
        pairs = []
        for k, a in enumerate(rows):
            for b in rows[k + 1:]:
                if a["name"] != b["name"] and (a["skipped"] or b["skipped"]) and ((a["skipped"] and b["skipped"]) or (a["first"] and b["first"])):
                    pairs += [(a["name"], b["name"]), (b["name"], a["name"])]
        if pairs:
            left, right = zip(*pairs)
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.string()), pa.array(right, pa.string())], ["name", "near"])


def _long_met(words: DataFrame) -> DataFrame:
    """word, n_near, form_n, form for pairs of words that meet under rotations of over LITERAL code points."""
    some = words.where(F.length("word") >= LITERAL)
    dealt = some.select("word").mapInArrow(_long_rotations, "key string, name string, skipped string, first boolean")
    pairs = dealt.repartition("key").sortWithinPartitions("key").mapInArrow(_long_pairs, "name string, near string")
    named = lambda name, *columns: some.mapInArrow(_named, "name string, word string, n long").toDF(name, *columns)
    known = pairs.join(named("name", "word", "own"), "name").join(named("near", "form", "form_n"), "near")
    return known.select("word", F.lit(1).cast("long").alias("n_near"), "form_n", "form")


def _named(batches: Batches) -> Batches:
    for batch in batches:
        names = pa.array([_name(w) for w in batch.column(0).to_pylist()], pa.string())
        yield pa.RecordBatch.from_arrays([names, batch.column(0), batch.column(1)], ["name", "word", "n"])


def near_words(words: DataFrame) -> DataFrame:
    """word, n_near, form, form_n: number of near words, and the near word of largest n (ties: smallest)."""
    met = literal_rotations(words).mapInArrow(_met, "word string, n_near long, form_n long, form string")
    met = met.unionByName(_long_met(words))
    best = F.min(F.struct((-F.col("form_n")).alias("rank"), "form"))
    found = met.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("best"))
    return found.select("word", "n_near", F.col("best.form").alias("form"), (-F.col("best.rank")).alias("form_n"))


def last_forms(forms: DataFrame) -> DataFrame:
    """word, root: where the chain word, form, form's form ... ends, for words that have a form; by pointer doubling."""
    ahead = written(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        step = ahead.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = written(ahead.join(step, "root", "left").select(
            "word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        ahead = moved.select("word", "root")
        if not single(moved.agg(F.count(F.when(F.col("moved"), 1)).alias("n")))["n"]:
            return ahead


def spelling_variants(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """word, form, root, n, n_near, form_n: one row per word."""
    words = word_counts(docs, doc_id, text)
    known = words.join(near_words(words), "word", "left")
    follows = F.col("form_n") >= RATIO * F.col("n")
    known = written(known.select(
        "word", F.when(follows, F.col("form")).alias("form"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(follows, F.col("form_n")).alias("form_n")), "variants")
    roots = last_forms(known.where(F.col("form").isNotNull()))
    return known.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
