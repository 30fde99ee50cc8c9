"""Approximate nearest neighbours by cosine with an inverted multi-index.

1. Equal vectors are one entry with their k + 1 smallest ids: ties go to the smaller id, so no answer needs more of them
   (a query leaves out its own row).  A vector with any number of copies is cut to k + 1 rows before the shuffle.
2. Unit vectors are split in two halves; each half has a codebook of K centroids, fitted with k-means to a sample of at
   most TRAIN entries (documented bound).  Every entry is put in the cell of its two nearest centroids.  K follows
   from the number of entries, so that cells hold CELL of them on average, up to K_MOST.
3. A query walks centroid pairs in order of summed distance with a heap (the multi-sequence walk) until the cells it has
   seen hold `reach` entries.  `reach` is measured, not guessed: for SAMPLE_QUERIES queries at most, the exact
   neighbours are found by a scan of all entries, and `reach` is where RECALL of those neighbours have been met.  On data
   without structure it is a large share of all entries, since no index can do better there.
4. Visited cells are joined with their entries as a grid of blocks of ENTRIES entries and QUERIES queries at most, so a
   crowded cell is spread.  A block is one matrix product and returns k + 1 candidates a query; candidates are scored
   again one by one, in double precision on the vectors as given.

Defined results: rows with a null id, and vectors that are null, empty, zero or hold null or non-finite components, take
no part; of vectors of several lengths, the most frequent length takes part (the smaller in a tie); rows equal in id and
vector are one; fewer candidates than k give fewer rows; an empty table gives none; other columns do not matter.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from linderos.llm.common import single, written

NEAREST = 5
TRAIN = 20_000
ROUNDS = 10
CELL = 512
K_LEAST, K_MOST = 2, 1_024
SAMPLE_QUERIES = 64
RECALL = 0.98
ENTRIES, QUERIES = 4_096, 2_048
SPARE = 4  # more candidates of a block than needed, before they are scored again
SEED = 11


def usable(vector: Column) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def vectors(table: DataFrame) -> DataFrame:
    """vec_id, v: the rows that take part."""
    rows = table.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    rows = rows.where(F.col("vec_id").isNotNull() & usable(F.col("v")))
    widths = rows.groupBy(F.size("v").alias("w")).agg(F.count(F.lit(1)).alias("n"))
    width = widths.orderBy(F.desc("n"), "w").first()
    return rows.where(F.size("v") == (width["w"] if width else 0))


def entries_of(rows: DataFrame, k: int) -> DataFrame:
    """entry (smallest id), v, ids (the k + 1 smallest): one row per distinct vector; written once."""
    same = Window.partitionBy("h", "v").orderBy("vec_id")
    few = rows.distinct().withColumn("h", F.xxhash64("v")).withColumn("r", F.row_number().over(same)).where(F.col("r") <= k + 1)
    return written(few.groupBy("h", "v").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")).select(
        F.col("ids")[0].alias("entry"), "v", "ids"), "entries")


def unit(v: np.ndarray) -> np.ndarray:
    """Rows of length one; scaled by the largest component first, so that no square over- or underflows."""
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def k_means(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    centroids = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(ROUNDS):
        nearest = np.argmin(distances(x, centroids), axis=1)
        count = np.bincount(nearest, minlength=len(centroids))
        total = np.zeros_like(centroids)
        np.add.at(total, nearest, x)
        centroids[count > 0] = total[count > 0] / count[count > 0, None]
    return centroids


def distances(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distances, less what is the same for all centroids."""
    return (centroids * centroids).sum(axis=1)[None, :] - 2 * x @ centroids.T


@dataclass(frozen=True)
class Codebooks:
    first: np.ndarray
    second: np.ndarray

    def halves(self, u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        cut = self.first.shape[1]
        return distances(u[:, :cut], self.first), distances(u[:, cut:], self.second)

    def cells(self, u: np.ndarray) -> np.ndarray:
        a, b = self.halves(u)
        return np.argmin(a, axis=1) * len(self.second) + np.argmin(b, axis=1)


def fit(entries: DataFrame, count: int) -> Codebooks:
    share = min(1.0, 1.2 * TRAIN / count)
    rank = F.xxhash64("entry", F.lit(SEED))
    some = entries.where(F.pmod(rank, F.lit(1 << 30)) <= int(share * (1 << 30))).select("v", rank.alias("rank"), "entry")
    sample = some.orderBy("rank", "entry").limit(TRAIN).select("v")
    pack = lambda batches: (pdf.assign(v=[np.asarray(v, dtype="<f8").tobytes() for v in pdf["v"]]) for pdf in batches)
    rows = sample.mapInPandas(pack, "v binary").collect() or entries.limit(1).select("v").mapInPandas(pack, "v binary").collect()
    u = unit(np.stack([np.frombuffer(r["v"], dtype="<f8") for r in rows]))
    k = int(min(K_MOST, max(K_LEAST, round(math.sqrt(count / CELL)))))
    cut, rng = (u.shape[1] + 1) // 2, np.random.default_rng(SEED)
    second = u[:, cut:] if u.shape[1] > 1 else np.zeros((len(u), 0))
    return Codebooks(k_means(u[:, :cut], k, rng), k_means(second, k, rng))


def walk(a: np.ndarray, b: np.ndarray) -> Iterator[tuple[int, int]]:
    """Pairs of places of `a` and `b` by ascending sum: a pair is pushed once both its predecessors are out."""
    first, second = np.argsort(a, kind="stable"), np.argsort(b, kind="stable")
    heap = [(a[first[0]] + b[second[0]], 0, 0)]
    reached = [0] * (len(a) + 1)  # how far each row of the grid has come out
    while heap:
        _, i, j = heapq.heappop(heap)
        yield int(first[i]), int(second[j])
        reached[i] = j + 1
        if i + 1 < len(a) and reached[i + 1] == j and (j == 0 or reached[i + 1] >= j):
            heapq.heappush(heap, (a[first[i + 1]] + b[second[j]], i + 1, j))
        if j + 1 < len(b) and (i == 0 or reached[i - 1] > j + 1):
            heapq.heappush(heap, (a[first[i]] + b[second[j + 1]], i, j + 1))


def matrix(values: pd.Series) -> np.ndarray:
    return np.stack(values.to_list()) if len(values) else np.zeros((0, 1))


def cosines(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Row by row, in double precision."""
    x, y = (v / np.abs(v).max(axis=1, keepdims=True) for v in (x, y))
    return (x * y).sum(axis=1) / (np.sqrt((x * x).sum(axis=1)) * np.sqrt((y * y).sum(axis=1)))


def best_of_block(q: np.ndarray, x: np.ndarray, ids: list[np.ndarray], k: int) -> list[list[tuple[float, int, int]]]:
    """For each query the k + 1 best (score, id, row), by score, then id; entries with several ids give several."""
    near = unit(q) @ unit(x).T
    take = min(len(x), k + 1 + SPARE)
    out = []
    for i, row in enumerate(near):
        if take < len(x):
            least = np.partition(row, len(x) - take)[len(x) - take]
            some = np.flatnonzero(row >= least - 1e-9)  # with everything that may tie
        else:
            some = np.arange(len(x))
        exact = cosines(np.broadcast_to(q[i], x[some].shape), x[some])
        found = [(-s, int(d), int(r)) for s, r in zip(exact, some) for d in ids[r]]
        out.append([(-s, d, r) for s, d, r in heapq.nsmallest(k + 1, found)])
    return out


def assign(entries: DataFrame, books: Codebooks) -> DataFrame:
    def put(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                yield pdf.assign(cell=books.cells(unit(matrix(pdf["v"]))))

    return written(entries.mapInPandas(put, "entry long, v array<double>, ids array<long>, cell int"), "cells")


def measured_reach(indexed: DataFrame, queries: DataFrame, books: Codebooks, occupied: np.ndarray, k: int) -> int:
    """How many entries a walk must pass to meet RECALL of the true neighbours, measured on a bounded set of queries."""
    some = queries.orderBy(F.xxhash64("query", F.lit(SEED)), "query").limit(SAMPLE_QUERIES).collect()
    if not some:
        return 0
    q = np.array([r["v"] for r in some])

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for first in range(0, len(pdf), ENTRIES):
                part = pdf.iloc[first:first + ENTRIES]
                cells = part["cell"].to_numpy()
                found = best_of_block(q, matrix(part["v"]), [i[:1] for i in part["ids"]], k)
                yield pd.DataFrame([(n, s, d, int(cells[r])) for n, best in enumerate(found) for s, d, r in best], columns=["n", "score", "id", "cell"])

    order = Window.partitionBy("n").orderBy(F.desc("score"), "id")
    true = indexed.mapInPandas(scan, "n int, score double, id long, cell int").withColumn("r", F.row_number().over(order)).where(F.col("r") <= k + 1)
    wanted: dict[int, list[int]] = {}
    for r in true.collect():
        wanted.setdefault(r["n"], []).append(r["cell"])
    places = []
    a, b = books.halves(unit(q))
    for n, cells in wanted.items():
        missing, passed = list(cells), 0
        for i, j in walk(a[n], b[n]):
            cell = i * len(books.second) + j
            passed += int(occupied[cell])
            places += [passed] * missing.count(cell)
            missing = [c for c in missing if c != cell]
            if not missing:
                break
    places.sort()
    return places[min(len(places) - 1, math.ceil(RECALL * len(places)))]


def probes(queries: DataFrame, books: Codebooks, occupied: np.ndarray, reach: int) -> DataFrame:
    """query, v, cell: the cells that each query visits."""
    def visit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf):
                continue
            a, b = books.halves(unit(matrix(pdf["v"])))
            for first in range(0, len(pdf), 256):
                rows, cells = [], []
                for n in range(first, min(first + 256, len(pdf))):
                    passed = 0
                    for i, j in walk(a[n], b[n]):
                        cell = i * len(books.second) + j
                        if occupied[cell]:
                            rows.append(n)
                            cells.append(cell)
                            passed += int(occupied[cell])
                            if passed >= reach:
                                break
                yield pdf.iloc[rows].assign(cell=cells)

    return queries.mapInPandas(visit, "query long, v array<double>, cell int")


def search(table: DataFrame, is_query: Column, k: int = NEAREST) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each row that `is_query` (on vec_id) holds for."""
    spark = table.sparkSession
    rows = written(vectors(table), "vectors")
    entries = entries_of(rows, k)
    count = entries.count()
    asked = rows.where(is_query).distinct()
    queries = written(asked.groupBy("v").agg(F.min("vec_id").alias("query")).select("query", "v"), "queries")
    if not count:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    books = fit(entries, count)
    indexed = assign(entries, books)
    cells = len(books.first) * len(books.second)  # K_MOST squared at most, as is everything counted by cell
    occupied = np.zeros(cells, dtype=np.int64)
    for r in indexed.groupBy("cell").count().collect():
        occupied[r["cell"]] = r["count"]
    reach = measured_reach(indexed, queries, books, occupied, k)
    visits = written(probes(queries, books, occupied, reach), "probes")
    grid = visits.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / QUERIES).cast("int").alias("nq")).join(
        indexed.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / ENTRIES).cast("int").alias("ne")), "cell")
    grid = F.broadcast(written(grid, "grid"))
    span = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = lambda key, n: F.pmod(F.xxhash64(key), F.col(n)).cast("int")
    left = visits.join(grid, "cell").select("cell", own("query", "nq").alias("q"), span("ne").alias("e"), "query", "v")
    right = indexed.join(grid, "cell").select("cell", own("entry", "ne").alias("e"), span("nq").alias("q"), "ids", "v")

    def block(asking: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(asking) and len(held):
            best = best_of_block(matrix(asking["v"]), matrix(held["v"]), held["ids"].to_list(), k)
            found = [(query, d, s) for query, some in zip(asking["query"], best) for s, d, _ in some]
        return pd.DataFrame(found, columns=["query", "id", "score"])

    met = left.groupBy("cell", "e", "q").cogroup(right.groupBy("cell", "e", "q")).applyInPandas(block, "query long, id long, score double")
    order = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    kept = met.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k + 1)
    lists = kept.groupBy("query").agg(F.array_sort(F.collect_list(F.struct("r", "id", "score"))).alias("near"))
    answered = queries.join(lists, "query").withColumn("h", F.xxhash64("v"))
    each = asked.withColumn("h", F.xxhash64("v")).join(answered.select("h", "v", "near"), ["h", "v"])
    others = F.slice(F.filter("near", lambda x: x["id"] != F.col("vec_id")), 1, k)
    return each.select(F.col("vec_id").alias("query_id"), F.posexplode(others).alias("p", "x")).select(
        "query_id", (F.col("p") + 1).cast("int").alias("rank"), F.col("x.id").alias("vec_id"), F.col("x.score").alias("score"))
