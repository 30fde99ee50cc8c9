"""Whitening of embeddings by shifted CholeskyQR.

1. Each entry c becomes the integer x = floor(256 * c); the fit list is each distinct x vector once.
2. The centred rows of the fit list are made orthonormal by passes over it.  A pass solves the rows against the
   triangular factors found so far, sums their Gram matrix by partition (d * d numbers each, added up by Spark) and
   factors it; the first factor is of the Gram matrix shifted by a small multiple of its trace, so that rows of any
   condition number have one, later ones are shifted only if they have to be.  Passes end when the Gram matrix is the
   identity (three as a rule, PASSES at most).
3. The factors are composed to one R, with R'R = A'A to double precision; its singular values and right vectors are the
   deviations and the components.  Forming A'A and taking its eigenvectors would lose half of the digits.
4. Every row that takes part is projected on the components, each scaled to unit variance over the fit list.

Centring is exact but for one rounding: x - S/n is computed as (x - S div n) - (S mod n) / n in integers and doubles.
The driver holds d * d numbers; each task one Arrow batch and d * d numbers.

Defined results: vectors that are null or hold null or non-finite entries, and those with an entry beyond 2^62 / 256 in
size (x would not be a long), are dropped; of vectors of several lengths the most frequent one above 0 takes part (the
smaller in a tie).  Ids are of any type and are carried as they are, null or repeated ones too; repeated rows are
repeated in the result and count once in the fit list.  Directions whose deviation is below RANK times the largest have
no unit variance and give no component, so fewer than asked may come, none for one distinct vector or an empty table.
`deviation` is null where it does not fit in a long.  Other columns do not matter.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, BinaryType, DoubleType, LongType, StructField, StructType

from linderos.llm.common import written

SCALE = 256
COMPONENTS = 4
PASSES = 12
RANK = 1e-13
LARGEST = float(1 << 62)
EPS = float(np.finfo(np.float64).eps)

Batches = Iterator[pa.RecordBatch]


def _fits(vector: Column) -> Column:
    scaled = lambda x: F.abs(x) * SCALE
    return F.coalesce(F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (scaled(x) < LARGEST)), F.lit(False))


def _packed(x: np.ndarray) -> list[bytes]:
    """Rows of integers, each in the narrowest of 2, 4 or 8 bytes an entry that holds all of them."""
    most = np.maximum(x.max(axis=1), -x.min(axis=1))
    out: list[bytes] = [b""] * len(x)
    sizes = np.where(most < 1 << 15, 2, np.where(most < 1 << 31, 4, 8))
    for size in np.unique(sizes):
        rows = np.flatnonzero(sizes == size)
        data, step = x[rows].astype(f"<i{size}").tobytes(), size * x.shape[1]
        for at, row in enumerate(rows):
            out[row] = data[at * step:(at + 1) * step]
    return out


def _unpacked(column: pa.Array, width: int) -> np.ndarray:
    values = column.to_pylist()
    sizes = np.array([len(v) for v in values], dtype=np.int64) // width
    x = np.empty((len(values), width), dtype=np.int64)
    for size in np.unique(sizes):
        rows = np.flatnonzero(sizes == size)
        x[rows] = np.frombuffer(b"".join(values[r] for r in rows), dtype=f"<i{size}").reshape(-1, width)
    return x


def integer_rows(table: DataFrame, id_column: str = "vec_id", vector: str = "embedding") -> tuple[DataFrame, int]:
    """(id, x): the rows that take part, their vectors as packed integers, written once; and the length of the vectors."""
    given = table.select(F.col(id_column).alias("id"), F.col(vector).cast("array<double>").alias("v"))
    given = given.where(_fits(F.col("v")) & (F.size("v") > 0))
    common = given.groupBy(F.size("v").alias("w")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "w").first()
    width = common["w"] if common else 0
    kind = StructType([given.schema["id"], StructField("x", BinaryType())])

    def pack(batches: Batches) -> Batches:
        for batch in batches:
            if len(batch):
                x = np.floor(batch.column(1).flatten().to_numpy().reshape(-1, width) * SCALE).astype(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(_packed(x), pa.binary())], ["id", "x"])

    return written(given.where(F.size("v") == width).mapInArrow(pack, kind), "whitening-rows"), width


def _summed(rows: DataFrame, width: int, partial: Callable[[Iterator[np.ndarray]], np.ndarray], size: int) -> np.ndarray:
    """`partial` gives `size` doubles for the vectors of a partition; their sums over all partitions.

    What is shuffled is `size` numbers a partition, under `size` keys.
    """
    def run(batches: Batches) -> Batches:
        total = partial(_unpacked(b.column(0), width) for b in batches if len(b))
        yield pa.RecordBatch.from_arrays([pa.array([total], pa.list_(pa.float64()))], ["sums"])

    parts = rows.select("x").mapInArrow(run, StructType([StructField("sums", ArrayType(DoubleType()))]))
    out = np.zeros(size)
    for r in parts.select(F.posexplode("sums").alias("at", "value")).groupBy("at").agg(F.sum("value").alias("value")).collect():
        out[r["at"]] = r["value"]
    return out


@dataclass(frozen=True)
class Centre:
    """Exact sums of n integer vectors, and their mean as an integer part and a rest below one."""

    n: int
    sums: list[int]

    @property
    def width(self) -> int:
        return len(self.sums)

    def centred(self, x: np.ndarray) -> np.ndarray:
        whole = np.array([s // self.n for s in self.sums], dtype=np.int64)
        rest = np.array([(s % self.n) / self.n for s in self.sums])
        return (x - whole).astype(np.float64) - rest

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Per row the exact sum of (n * x - S)^2, from sums of x^2 and x * S; in longs where these fit, else in Python's."""
        most = max(int(np.abs(x).max()), 1)
        if most * max(most, *(abs(s) for s in self.sums)) * self.width < 1 << 62:
            squares, products = (x * x).sum(axis=1).tolist(), (x @ np.array(self.sums, dtype=np.int64)).tolist()
        else:
            big = x.astype(object)
            squares, products = (big * big).sum(axis=1).tolist(), (big @ np.array(self.sums, dtype=object)).tolist()
        own = sum(s * s for s in self.sums)
        exact = [self.n * self.n * a - 2 * self.n * b + own for a, b in zip(squares, products)]
        return [v if v < 1 << 63 else None for v in exact]


def centre_of(points: DataFrame, width: int) -> Centre:
    """Count and exact sums: high and low halves of the integers are added up apart, by Spark in decimals."""
    kind = "at int, n long, high long, low long"

    def run(batches: Batches) -> Batches:
        n, high, low = 0, np.zeros(width, dtype=np.int64), np.zeros(width, dtype=np.int64)
        for batch in batches:
            if len(batch):
                x = _unpacked(batch.column(0), width)
                n, high, low = n + len(x), high + (x >> 31).sum(axis=0), low + (x & ((1 << 31) - 1)).sum(axis=0)
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(width), pa.int32()), pa.array([n] * width, pa.int64()), pa.array(high), pa.array(low)], ["at", "n", "high", "low"])

    wide = lambda c: F.sum(F.col(c).cast("decimal(20,0)")).alias(c)
    sums = points.select("x").mapInArrow(run, kind).groupBy("at").agg(F.sum("n").alias("n"), wide("high"), wide("low")).collect()
    found = {r["at"]: (r["n"], (int(r["high"]) << 31) + int(r["low"])) for r in sums}
    return Centre(found[0][0], [found[k][1] for k in range(width)]) if found and found[0][0] else Centre(0, [0] * width)


def solved(rows: np.ndarray, factors: list[np.ndarray]) -> np.ndarray:
    """rows times the inverse of each upper triangular factor in turn, by forward substitution over the columns."""
    for r in factors:
        q = np.empty_like(rows)
        for j in range(r.shape[1]):
            q[:, j] = (rows[:, j] - q[:, :j] @ r[:j, j]) / r[j, j]
        rows = q
    return rows


def shifted_factor(gram: np.ndarray, shift: bool) -> np.ndarray:
    """Upper triangular R with R'R = gram + s * I; s starts at 0, or with `shift` at its least, and grows until there is one."""
    d = len(gram)
    least = 11 * (d + 1) * EPS * np.trace(gram)
    s = least if shift else 0.0
    while True:
        try:
            return np.linalg.cholesky(gram + s * np.eye(d)).T
        except np.linalg.LinAlgError:
            s = max(least, 8 * s)


def triangular_factor(points: DataFrame, centre: Centre) -> np.ndarray:
    """R with R'R = A'A for the centred rows A, from repeated Gram passes."""
    d = centre.width
    factors: list[np.ndarray] = []
    composed = np.eye(d)
    for turn in range(PASSES):
        def partial(parts: Iterator[np.ndarray], known: tuple[np.ndarray, ...] = tuple(factors)) -> np.ndarray:
            total = np.zeros((d, d))
            for x in parts:
                q = solved(centre.centred(x), list(known))
                total += q.T @ q
            return total.ravel()

        gram = _summed(points, d, partial, d * d).reshape(d, d)
        gram = (gram + gram.T) / 2
        if not np.trace(gram) > 0:
            return np.zeros((d, d))
        factors.append(shifted_factor(gram, shift=turn == 0))
        composed = factors[-1] @ composed
        if np.abs(gram - np.eye(d)).max() < 64 * d * EPS:
            break
    return composed


@dataclass(frozen=True)
class Whitening:
    """Centre, components (columns), their eigenvalues and share of the whole variance, and how far the covariance of the
    whitened fit list is from the identity."""

    centre: Centre
    components: np.ndarray
    eigenvalues: np.ndarray
    explained: np.ndarray
    identity_error: float = 0.0

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.centre.centred(x) @ self.components / np.sqrt(self.eigenvalues)


def fit(points: DataFrame, width: int, components: int = COMPONENTS) -> Whitening:
    """Components of the distinct integer vectors in `points`, which are read once a pass."""
    centre = centre_of(points, width)
    if not centre.n:
        return Whitening(centre, np.zeros((width, 0)), np.zeros(0), np.zeros(0))
    _, deviations, right = np.linalg.svd(triangular_factor(points, centre))
    rank = int((deviations > RANK * deviations[0]).sum()) if deviations[0] > 0 else 0
    k = min(components, rank)
    axes = right[:k].T
    axes = axes * np.where(axes[np.abs(axes).argmax(axis=0), np.arange(k)] < 0, -1.0, 1.0)
    squares = deviations**2
    model = Whitening(centre, axes, squares[:k] / centre.n, squares[:k] / squares.sum() if k else np.zeros(0))
    if not k:
        return model

    def partial(parts: Iterator[np.ndarray]) -> np.ndarray:
        total = np.zeros((k, k + 1))
        for x in parts:
            w = model.whitened(x)
            total += w.T @ np.column_stack([w, np.ones(len(w))])
        return total.ravel()

    moments = _summed(points, width, partial, k * (k + 1)).reshape(k, k + 1) / centre.n
    covariance = moments[:, :k] - np.outer(moments[:, k], moments[:, k])
    return Whitening(centre, axes, model.eigenvalues, model.explained, float(np.abs(covariance - np.eye(k)).max()))


def whiten(table: DataFrame, components: int = COMPONENTS, id_column: str = "vec_id", vector: str = "embedding") -> tuple[DataFrame, Whitening]:
    """(id, deviation, whitened): each row that takes part, projected; and the model it was projected with."""
    rows, width = integer_rows(table, id_column, vector)
    model = fit(written(rows.select("x").distinct(), "whitening-points"), width, components)
    kind = StructType([
        StructField(id_column, rows.schema["id"].dataType), StructField("deviation", LongType()),
        StructField("whitened", ArrayType(DoubleType()))])

    def project(batches: Batches) -> Batches:
        for batch in batches:
            if len(batch):
                x = _unpacked(batch.column(1), width)
                yield pa.RecordBatch.from_arrays([
                    batch.column(0), pa.array(model.centre.deviations(x), pa.int64()),
                    pa.array(list(model.whitened(x)), pa.list_(pa.float64())),
                ], [id_column, "deviation", "whitened"])

    return rows.mapInArrow(project, kind), model
