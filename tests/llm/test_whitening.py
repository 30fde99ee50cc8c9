import math

import numpy as np
import pytest

from linderos.llm import whitening
from linderos.llm.queries import QUERIES
from tests.conftest import SMALL

SCHEMA = "vec_id long, embedding array<double>, x binary, deviation string, at int, id string"


def table(spark, vectors, ids=None, schema=SCHEMA):
    ids = range(len(vectors)) if ids is None else ids
    return spark.createDataFrame([(i, v, b"x", "d", 3, "other") for i, v in zip(ids, vectors)], schema)


def plain(vectors, k=4):
    """x, n, S, deviations, components by the definition: exact integers, then eigenvectors of V in extended precision."""
    x = [[math.floor(256 * c) for c in v] for v in vectors]
    distinct = sorted(set(map(tuple, x)))
    n, sums = len(distinct), [sum(col) for col in zip(*distinct)]
    centred = np.array([[(n * c - s) / n for c, s in zip(v, sums)] for v in distinct])
    _, s, right = np.linalg.svd(centred, full_matrices=False)
    deviations = [sum((n * c - t) ** 2 for c, t in zip(v, sums)) for v in x]
    own = np.array([[(n * c - t) / n for c, t in zip(v, sums)] for v in x])
    return n, deviations, own @ right[:k].T / (s[:k] / math.sqrt(n)), s[:k] ** 2 / (s**2).sum()


def check(found, vectors, tolerance=1e-8, off=1e-9):
    n, deviations, whitened, explained = plain(vectors)
    rows = {}
    for r in found:
        rows.setdefault(r["vec_id"], {})[r["component"]] = r
    signs = np.sign([rows[0][c]["whitened"] * whitened[0, c - 1] for c in sorted(rows[0])])
    for i in range(len(vectors)):
        for c, r in rows[i].items():
            assert r["n"] == n and r["deviation"] == (deviations[i] if deviations[i] < 1 << 63 else None)
            assert r["whitened"] == pytest.approx(signs[c - 1] * whitened[i, c - 1], abs=tolerance)
            assert r["explained"] == pytest.approx(explained[c - 1], rel=1e-9)
            assert r["identity_error"] < off
    return rows


def flat(result):
    rows, model = result
    return [dict(vec_id=r["vec_id"], component=c + 1, n=model.centre.n, deviation=r["deviation"], whitened=w, explained=model.explained[c], identity_error=model.identity_error)
            for r in rows.collect() for c, w in enumerate(r["whitened"])]


def test_query_is_the_definition(spark):
    vectors = {r["vec_id"]: r["embedding"] for r in spark.read.parquet(f"{SMALL}/embeddings.parquet").collect()}
    rows = check(QUERIES["op11_embedding_whitening"](spark, SMALL).collect(), [vectors[i] for i in range(len(vectors))])
    assert len(rows) == len(vectors) and all(len(r) == 4 for r in rows.values())


def test_ill_conditioned_rows_keep_their_digits(spark):
    rng = np.random.default_rng(5)
    scale = 10.0 ** np.array([9, 5, 2, 0, 0, 0])  # condition number 1e9: that of A'A is beyond double precision
    x = rng.standard_normal((200, 6)) * scale @ np.linalg.qr(rng.standard_normal((6, 6)))[0]
    check(flat(whitening.whiten(table(spark, x.tolist()))), x.tolist(), 1e-5, 1e-6)


def test_far_from_the_origin(spark):
    x = (np.random.default_rng(6).standard_normal((60, 3)) + 2.0**40).tolist()
    check(flat(whitening.whiten(table(spark, x))), x, 1e-7)


def test_repeats_count_once_in_the_fit_and_come_back(spark):
    base = np.random.default_rng(7).standard_normal((30, 5)).tolist()
    vectors = base + [base[0]] * 50
    check(flat(whitening.whiten(table(spark, vectors))), vectors)


def test_few_directions(spark):
    rng = np.random.default_rng(8)
    flat_plane = (rng.integers(-50, 50, (40, 2)) @ rng.integers(-5, 5, (2, 6))).astype(float)
    rows, model = whitening.whiten(table(spark, flat_plane.tolist()))
    assert model.components.shape == (6, 2) and model.identity_error < 1e-9 and rows.count() == 40
    rows, model = whitening.whiten(table(spark, [[1.0, 2.0]] * 4))
    assert len(model.explained) == 0 and sorted(tuple(r) for r in rows.collect()) == [(i, 0, []) for i in range(4)]


def test_unusable_and_ragged_rows_are_dropped(spark):
    good = np.random.default_rng(9).standard_normal((20, 3)).tolist()
    bad = [None, [], [1.0, None, 2.0], [float("nan"), 0.0, 1.0], [float("inf"), 0.0, 1.0], [1.0, 2.0], [1e30, 0.0, 0.0]]
    rows = check(flat(whitening.whiten(table(spark, good + bad))), good)
    assert sorted(rows) == list(range(20))
    empty, model = whitening.whiten(table(spark, []))
    assert empty.collect() == [] and model.centre.n == 0
    assert whitening.whiten(table(spark, bad[:5]))[0].collect() == []


def test_ids_are_carried_as_they_are(spark):
    vectors = np.random.default_rng(10).standard_normal((4, 3)).tolist()
    ids = [(1 << 60) + 1, None, (1 << 60) + 3, (1 << 60) + 3]
    assert sorted((r["vec_id"] or 0) for r in whitening.whiten(table(spark, vectors, ids))[0].collect()) == sorted(i or 0 for i in ids)
    named = table(spark, vectors, ["a", None, "b", "b"], SCHEMA.replace("vec_id long", "vec_id string"))
    assert sorted(r["vec_id"] or "" for r in whitening.whiten(named)[0].collect()) == ["", "a", "b", "b"]


def test_deviation_beyond_a_long_is_null(spark):
    vectors = [[2.0**50, 1.0], [-(2.0**50), 2.0], [0.5, 3.0]]
    told = {r["vec_id"]: r["deviation"] for r in whitening.whiten(table(spark, vectors))[0].collect()}
    assert told[0] is None and told[1] is None
    check(flat(whitening.whiten(table(spark, vectors))), vectors)


def test_triangular_solve_and_shift():
    rng = np.random.default_rng(11)
    a, r = rng.standard_normal((9, 4)), np.triu(rng.standard_normal((4, 4))) + 4 * np.eye(4)
    assert np.allclose(whitening.solved(a @ r, [r]), a)
    singular = np.ones((3, 3))
    factor = whitening.shifted_factor(singular, shift=True)
    assert np.allclose(factor.T @ factor, singular, atol=1e-9) and np.allclose(factor, np.triu(factor))
