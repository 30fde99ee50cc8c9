"""Quality classifier: ridge regression on random Fourier features of document statistics, calibrated isotonically.

1. Each whole text becomes STATISTICS numbers (lengths, character classes, repetition, lines).
2. Labelled rows are standardised with their own means and deviations (one aggregated row) and mapped to FEATURES random
   Fourier features cos(xW + b), which approximate a Gaussian kernel of width WIDTH.
3. Every partition sums its part of the normal equations for each fold; the parts are added on Spark in two levels, and
   one FEATURES x FEATURES matrix for each fold, a size that does not depend on the data, comes to the driver.
4. Each fold's rows are scored by the model fitted to the other folds; their scores are counted in BINS bins on Spark, and
   pooling adjacent violators makes the rate of label 1 a non-decreasing function of the score.
5. The model of all folds and that function score every document.

The folds are crc32(doc_id) mod 5; rows of fold 0 are held out and never learnt from.  Only the text is an input of a
score.  All labelled rows are used; there is no sample.

Defined results: null text is scored as empty text; a null doc_id counts as the empty string and has no label; several
labels of one id all count; labels other than 0 and 1 are left out; without any label, or with one class only, the score
is the share of label 1 (0.5 without labels).  Repeated rows get equal scores.  Other columns do not matter.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructField, StructType

from linderos.llm.common import spare_name, written

FOLDS = 5
FEATURES = 256
WIDTH = 4.0
RIDGE = 1e-4
CLIP = 6.0
BINS = 1_024
SEED = 20_240
ACCEPT = 0.3

_CLASSES = {
    "lower": b"abcdefghijklmnopqrstuvwxyz", "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digit": b"0123456789", "blank": b" \t",
    "line": b"\n\r", "stop": b".,;:", "cry": b"!?", "bar": b"|", "quote": b"\"'()-", "sign": b"#$%&*+/<=>@[\\]^_`{}~",
}
_CLASS_OF = np.full(256, len(_CLASSES), dtype=np.int64)
for _n, _members in enumerate(_CLASSES.values()):
    _CLASS_OF[list(_members)] = _n
STATISTICS = len(_CLASSES) + 1 + 12


def statistics(text: str | None) -> list[float]:
    """The numbers that describe one whole text."""
    raw = (text or "").encode("utf-8", "replace")
    by_byte = np.bincount(np.frombuffer(raw, dtype=np.uint8), minlength=256)
    by_class = np.bincount(_CLASS_OF, weights=by_byte, minlength=len(_CLASSES) + 1)
    n_bytes = max(1, len(raw))
    words = (text or "").split()
    n = max(1, len(words))
    counts = Counter(words)
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words)) if words else np.zeros(1, dtype=np.int64)
    lines = [line for line in (text or "").split("\n") if line]
    n_lines = max(1, len(lines))
    return [
        *(by_class / n_bytes),
        math.log1p(len(raw)), math.log1p(len(words)), math.log1p(n_lines), math.log1p(n_bytes / n_lines),
        float(lengths.mean()), float(lengths.std()),
        len(counts) / n, max(counts.values(), default=0) / n,
        sum(map(eq, words, words[1:])) / n,
        1 - len(set(lines)) / n_lines,
        sum(map(str.isupper, words)) / n,
        len(counts) / math.sqrt(n),
    ]


@F.pandas_udf(ArrayType(DoubleType()))
def _statistics(texts: pd.Series) -> pd.Series:
    return pd.Series([statistics(t) for t in texts], dtype=object)


@dataclass(frozen=True)
class Model:
    """What scoring needs; its size does not depend on the data."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray | None  # of the random features and a constant
    knots: np.ndarray  # raw scores, ascending
    rates: np.ndarray  # calibrated rates at the knots
    prior: float

    def score(self, stats: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(stats), self.prior)
        return np.interp(fourier(stats, self.mean, self.scale) @ self.weights, self.knots, self.rates)


def _directions() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(SEED)
    return rng.normal(0, 1 / WIDTH, (STATISTICS, FEATURES)), rng.uniform(0, 2 * math.pi, FEATURES)


def fourier(stats: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Random Fourier features and a constant."""
    w, b = _directions()
    x = np.clip((stats - mean) / scale, -CLIP, CLIP)
    return np.hstack([math.sqrt(2 / FEATURES) * np.cos(x @ w + b), np.ones((len(x), 1))])


def fold_of(doc_id: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))), F.lit(FOLDS)).cast("int")


def document_statistics(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, fold, stats; written once, as learning and scoring both read it and it is far smaller than the text."""
    source = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return written(source.select("doc_id", fold_of(F.col("doc_id")).alias("fold"), _statistics("text").alias("stats")), "statistics")


def labelled(stats: DataFrame, labels: DataFrame) -> DataFrame:
    """fold, stats, y of the rows to learn from."""
    known = labels.where(F.col("quality").isin(0, 1) & (fold_of(F.col("doc_id")) != 0)).select(
        "doc_id", F.col("quality").cast("double").alias("y"))
    return stats.where(F.col("fold") != 0).join(known, "doc_id").select("fold", "stats", "y")


_PART = StructType([
    StructField("fold", IntegerType()), StructField("row", IntegerType()), StructField("values", ArrayType(DoubleType())),
])


def _added(parts: DataFrame, spread: int = 64) -> DataFrame:
    """Sums of `values` by fold and row, first in `spread` groups of partitions, then over them."""
    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"fold": pdf["fold"][:1], "row": pdf["row"][:1], "values": [np.sum(np.stack(pdf["values"].to_list()), axis=0)]})

    some = parts.withColumn("part", F.spark_partition_id() % spread).groupBy("fold", "row", "part").applyInPandas(add, _PART)
    return some.groupBy("fold", "row").applyInPandas(add, _PART)


def normal_equations(rows: DataFrame, mean: np.ndarray, scale: np.ndarray) -> dict[int, np.ndarray]:
    """[Z'Z | Z'y] of each fold."""
    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[int, np.ndarray] = {}
        for pdf in batches:
            if len(pdf) == 0:
                continue
            z = fourier(np.stack(pdf["stats"].to_list()), mean, scale)
            zy = np.hstack([z, pdf["y"].to_numpy()[:, None]])
            folds = pdf["fold"].to_numpy()
            for fold in np.unique(folds):
                own = folds == fold
                sums[int(fold)] = sums.get(int(fold), 0) + z[own].T @ zy[own]
        for fold, matrix in sums.items():
            yield pd.DataFrame({"fold": fold, "row": np.arange(len(matrix)), "values": list(matrix)})

    matrices: dict[int, np.ndarray] = {}
    for r in _added(rows.mapInPandas(part, _PART)).collect():  # FOLDS x (FEATURES + 1) rows
        matrices.setdefault(r["fold"], np.zeros((FEATURES + 1, FEATURES + 2)))[r["row"]] = r["values"]
    return matrices


def solve(matrix: np.ndarray) -> np.ndarray:
    n = matrix[-1, -2]  # the constant's square, summed
    ridge = RIDGE * n * np.eye(len(matrix))
    ridge[-1, -1] = 0
    return np.linalg.solve(matrix[:, :-1] + ridge + 1e-9 * np.eye(len(matrix)), matrix[:, -1])


def pool_adjacent_violators(x: np.ndarray, positive: np.ndarray, total: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Non-decreasing rates by weighted least squares; each block's rate at the weighted mean of its places."""
    blocks: list[list[float]] = []  # sum of places, positives, weight
    for place, p, t in zip(x, positive, total):
        blocks.append([place * t, p, t])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            top = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], top)]
    return np.array([b[0] / b[2] for b in blocks]), np.array([b[1] / b[2] for b in blocks])


def calibration(rows: DataFrame, mean: np.ndarray, scale: np.ndarray, weights: dict[int, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf) == 0:
                continue
            z = fourier(np.stack(pdf["stats"].to_list()), mean, scale)
            raw = np.einsum("ij,ij->i", z, np.stack([weights[f] for f in pdf["fold"]]))
            place = np.floor((np.clip(raw, -0.5, 1.5) + 0.5) / 2 * BINS)
            yield pd.DataFrame({"place": np.minimum(place, BINS - 1).astype("int32"), "y": pdf["y"]})

    bins = rows.mapInPandas(score, "place int, y double").groupBy("place").agg(F.sum("y").alias("p"), F.count("y").alias("t"))
    found = sorted((r["place"], r["p"], r["t"]) for r in bins.collect())  # BINS rows at most
    place, positive, total = map(np.array, zip(*found))
    return pool_adjacent_violators((place + 0.5) / BINS * 2 - 0.5, positive, total)


def fit(stats: DataFrame, labels: DataFrame) -> Model:
    rows = written(labelled(stats, labels), "labelled")
    moments = rows.select("y", *[F.col("stats")[k].alias(f"s{k}") for k in range(STATISTICS)]).agg(
        F.count("y").alias("n"), F.avg("y").alias("rate"),
        *[F.avg(f"s{k}").alias(f"m{k}") for k in range(STATISTICS)], *[F.stddev_pop(f"s{k}").alias(f"d{k}") for k in range(STATISTICS)],
    ).collect()[0]
    none = np.zeros(0)
    if not moments["n"] or moments["rate"] in (0.0, 1.0):
        prior = 0.5 if not moments["n"] else moments["rate"]
        return Model(np.zeros(STATISTICS), np.ones(STATISTICS), None, none, none, prior)
    mean = np.array([moments[f"m{k}"] for k in range(STATISTICS)])
    scale = np.array([moments[f"d{k}"] for k in range(STATISTICS)])
    scale = np.where(scale > 1e-12, scale, 1.0)
    parts = normal_equations(rows, mean, scale)
    whole = sum(parts.values())
    weights = {fold: solve(whole - part if len(parts) > 1 else whole) for fold, part in parts.items()}
    knots, rates = calibration(rows, mean, scale, weights)
    return Model(mean, scale, solve(whole), knots, rates, moments["rate"])


def scores(stats: DataFrame, model: Model) -> DataFrame:
    """doc_id, fold, score."""
    @F.pandas_udf(DoubleType())
    def score(values: pd.Series) -> pd.Series:
        return pd.Series(model.score(np.stack(values.to_list())) if len(values) else [], dtype=float)

    return stats.select("doc_id", "fold", score("stats").alias("score"))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, fold, score of every document."""
    stats = document_statistics(docs)
    return scores(stats, fit(stats, labels))


def keep_good(docs: DataFrame, labels: DataFrame, least: float = ACCEPT, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of `docs` whose score is `least` or more, columns unchanged."""
    model = fit(document_statistics(docs, doc_id, text), labels)

    @F.pandas_udf(DoubleType())
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(model.score(np.array([statistics(t) for t in texts])) if len(texts) else [], dtype=float)

    name = spare_name(docs, "score")
    return docs.withColumn(name, score(F.col(text))).where(F.col(name) >= least).drop(name)
