"""Benchmark decontamination with a broadcast hash set of test n-grams; DataFrame functions only.

Words: A-Z lower-cased, then runs of `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]`.  A window is `n` consecutive words of a
benchmark item; an item with fewer words, but not none, is one window.  The document side makes no n-gram strings: each
word position is one generated row that hashes the words behind it and probes the broadcast set; only a position whose
hash is found has its words joined and compared.  Words inside any verified window are hit.

The broadcast side is bounded: `WINDOWS_PER_BLOCK` distinct windows at most in expectation, whatever the size of the
benchmark.  A larger benchmark is dealt by hash into blocks, and the documents are scanned once for each block and window
length (short items have lengths of their own); the union of the scans is the whole answer.  Hits leave the scan as (document, position), so a window that many documents
share is spread over the documents, and items are looked up per distinct window of a document.

Rows are told apart by id and a 128-bit fingerprint of the text, which are what gets shuffled.  Defined results: null
or empty text, or text without words: no words, no hits.  Rows with equal id and text are reported once each.  Items
with null text have no words.  A null doc_id is a value like others.  An empty benchmark hits nothing.  Columns other
than those named are ignored by the report and kept by the filters.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, functions as F

from linderos.llm.common import fingerprint, picked, single, spare_name, written

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW = 10
WINDOWS_PER_BLOCK = 1_000_000
HASH_SEEDS = range(8)


def lower_ascii(text: Column) -> Column:
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def words_of(text: Column) -> Column:
    """The words of a text; an empty array for null."""
    return F.coalesce(F.array_remove(F.split(lower_ascii(text), SEPARATORS), ""), F.array().cast("array<string>"))


def _window_hash(words: Column, at: Column, length: int, seed: int) -> Column:
    return F.xxhash64(F.lit(seed), F.lit(length), *[F.get(words, at + k) for k in range(length)])


def benchmark_windows(benchmark: DataFrame, n: int = WINDOW) -> DataFrame:
    """item_id, length, gram (words joined by blanks): the distinct windows of each item."""
    items = benchmark.select("item_id", words_of(F.col("text")).alias("w")).where(F.size("w") > 0)
    length = F.least(F.size("w"), F.lit(n))
    return (
        items.select("item_id", "w", length.alias("length"), F.explode(F.sequence(F.lit(1), F.size("w") - length + 1)).alias("at"))
        .select("item_id", "length", F.array_join(F.slice("w", F.col("at"), F.col("length")), " ").alias("gram"))
        .distinct()
    )


def _gram_hash(gram: Column, length: int, seed: int) -> Column:
    return _window_hash(F.split(gram, " "), F.lit(0), length, seed)


def _keyed(windows: DataFrame, lengths: list[int], seed: int) -> DataFrame:
    key = F.coalesce(*[F.when(F.col("length") == k, _gram_hash(F.col("gram"), k, seed)) for k in lengths])
    return windows.select("item_id", "length", "gram", key.alias("key"))


def keyed_windows(benchmark: DataFrame, n: int = WINDOW) -> tuple[DataFrame, list[int], int, int]:
    """Windows with a 64-bit key that no two different windows share; their lengths; the seed; how many there are.

    The windows are written once.  Which lengths occur (n at most), and how many distinct windows and keys there are,
    come to the driver as one row.
    """
    windows = written(benchmark_windows(benchmark, n), "windows")
    lengths = sorted(single(windows.agg(F.collect_set("length").alias("l")))["l"])
    if not lengths:
        return windows.withColumn("key", F.lit(None).cast("long")), [], 0, 0
    for seed in HASH_SEEDS:
        keyed = _keyed(windows, lengths, seed)
        seen = single(keyed.agg(F.countDistinct("length", "gram").alias("grams"), F.countDistinct("key").alias("keys")))
        if seen["grams"] == seen["keys"]:
            return keyed, lengths, seed, seen["grams"]
    raise RuntimeError("every seed made two windows collide")


def scan(docs: DataFrame, keyed: DataFrame, lengths: list[int], seed: int, count: int, text: str = "text",
         doc_id: str = "doc_id", windows_per_block: int = WINDOWS_PER_BLOCK) -> DataFrame:
    """doc_id, print, n_words, copies, hits: one row per distinct (doc_id, text), hits an array of (at, length, key)."""
    source = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).select(
        "doc_id", fingerprint(F.col("text")).alias("print"), words_of(F.col("text")).alias("w")
    ).select("doc_id", "print", "w", F.size("w").alias("n_words"))
    blocks = max(1, -(-count // windows_per_block))
    grams = keyed.select("length", "gram", "key").distinct()
    # Position -1 stands for the row itself and finds nothing.
    places = source.select("doc_id", "print", "n_words", "w", F.explode(F.sequence(F.lit(-1), F.col("n_words") - 1)).alias("at"))
    inside = lambda k: (F.col("at") >= 0) & (F.col("at") + k <= F.col("n_words"))
    found = None
    for block in range(blocks):
        part = grams.where(F.pmod(F.xxhash64("key"), F.lit(blocks)) == block) if blocks > 1 else grams
        for first, k in enumerate(lengths or [1]):
            own = part.where(F.col("length") == k).select(F.col("key").alias("k"), "gram")
            probe = places.withColumn("key", F.when(inside(k), _window_hash(F.col("w"), F.col("at"), k, seed)))
            # Two inequalities: an equality would become a join key, and every position would have its words joined.
            gram = F.array_join(F.slice("w", F.greatest(F.col("at"), F.lit(0)) + 1, k), " ")
            same = (gram >= F.col("gram")) & (gram <= F.col("gram"))
            rows = probe.join(F.broadcast(own), (F.col("key") == F.col("k")) & same, "left")
            whole = F.col("at") == -1 if block == 0 and first == 0 else F.lit(False)
            rows = rows.where(F.col("k").isNotNull() | whole).select(
                "doc_id", "print", "n_words", F.when(F.col("at") == -1, 1).alias("row"),
                F.when(F.col("k").isNotNull(), F.struct("at", F.lit(k).alias("length"), F.col("k").alias("key"))).alias("hit"),
            )
            found = rows if found is None else found.unionAll(rows)
    return found.groupBy("doc_id", "print", "n_words").agg(
        F.count("row").alias("copies"), F.array_sort(F.collect_set("hit")).alias("hits")
    )


def covered(hits: Column) -> Column:
    """How many words lie inside sorted hits."""
    start = F.struct(F.lit(0).alias("sum"), F.lit(0).alias("end"))
    step = lambda acc, h: F.struct(
        (acc["sum"] + F.greatest(F.lit(0), h["at"] + h["length"] - F.greatest(h["at"], acc["end"]))).alias("sum"),
        F.greatest(acc["end"], h["at"] + h["length"]).alias("end"),
    )
    return F.aggregate(hits, start, step, lambda acc: acc["sum"])


def contamination(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW, **options) -> DataFrame:
    """doc_id, print, n_words, copies, n_hit, hits, items (distinct item_ids with occurring windows)."""
    keyed, lengths, seed, count = keyed_windows(benchmark, n)
    found = written(scan(docs, keyed, lengths, seed, count, **options), "hits")
    report = found.withColumn("n_hit", covered(F.col("hits")))
    of_doc = ["doc_id", "print"]
    pairs = (
        found.where(F.size("hits") > 0)
        .select(*of_doc, F.explode(F.array_distinct(F.transform("hits", lambda h: h["key"]))).alias("key"))
        .join(keyed.select("key", "item_id").distinct(), "key")
        .groupBy(*of_doc).agg(F.collect_set("item_id").alias("items"), F.max(F.col("item_id").isNull()).alias("any_null"))
        .select(*[F.col(c).alias(f"i_{c}") for c in of_doc], "items")
    )
    same = F.col("doc_id").eqNullSafe(F.col("i_doc_id")) & (F.col("print") == F.col("i_print"))
    return report.join(pairs, same, "left").drop("i_doc_id", "i_print").withColumn(
        "items", F.coalesce("items", F.array().cast(pairs.schema["items"].dataType)))


def _contaminated_keys(docs: DataFrame, benchmark: DataFrame, n: int, **options) -> DataFrame:
    keyed, lengths, seed, count = keyed_windows(benchmark, n)
    return written(scan(docs, keyed, lengths, seed, count, **options).where(F.size("hits") > 0), "hits")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW, doc_id: str = "doc_id",
                      text: str = "text", **options) -> DataFrame:
    """The rows of `docs` without a hit, columns unchanged."""
    hit = _contaminated_keys(docs, benchmark, n, doc_id=doc_id, text=text, **options)
    i, p = spare_name(docs, "hit_id"), spare_name(docs, "hit_print")
    hit = picked(hit.select(F.col("doc_id").alias(i), F.col("print").alias(p)))
    return docs.join(hit, F.col(doc_id).eqNullSafe(F.col(i)) & (fingerprint(F.col(text)) == F.col(p)), "left_anti")


def remove_spans(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW, doc_id: str = "doc_id", text: str = "text",
                 **options) -> DataFrame:
    """The rows of `docs` with hit words, and the separators behind each, taken out of the text; columns unchanged."""
    hit = _contaminated_keys(docs, benchmark, n, doc_id=doc_id, text=text, **options)
    i, p, h = (spare_name(docs, s) for s in ("hit_id", "hit_print", "hit_spans"))
    hit = hit.select(F.col("doc_id").alias(i), F.col("print").alias(p), F.col("hits").alias(h))
    both = docs.join(hit, F.col(doc_id).eqNullSafe(F.col(i)) & (fingerprint(F.col(text)) == F.col(p)), "left")
    word = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"  # as SEPARATORS, with capitals
    pieces = F.regexp_extract_all(F.col(text), F.lit(f"({word}[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]*)"), F.lit(1))
    lead = F.regexp_extract(F.col(text), r"^[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*", 0)
    places = F.flatten(F.transform(F.col(h), lambda s: F.sequence(s["at"], s["at"] + s["length"] - 1)))
    kept = F.array_except(F.sequence(F.lit(0), F.size(pieces) - 1), places)
    cleaned = F.concat(lead, F.array_join(F.transform(kept, lambda k: F.get(pieces, k)), ""))
    return both.withColumn(text, F.when(F.col(h).isNotNull(), cleaned).otherwise(F.col(text))).select(*docs.columns)
