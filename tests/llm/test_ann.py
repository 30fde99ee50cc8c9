import numpy as np
import pytest
from pyspark.sql import functions as F

from linderos.llm import ann


def table(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 1) for i, v in rows],
                                 "vec_id long, embedding array<float>, entry int")


def brute(rows, every=50, k=5):
    valid = {(i, tuple(np.float32(v).tolist())) for i, v in rows if i is not None and v is not None and len(v) == 8
             and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    out = {}
    for i, v in valid:
        if i % every == 0:
            a = np.array(v, dtype=float)
            scored = sorted((-float(np.round(a @ np.array(w) / np.linalg.norm(a) / np.linalg.norm(w), 12)), j) for j, w in valid if j != i)
            out.setdefault(i, [j for _, j in scored[:k]])
    return out


def found(df):
    lists, scores = {}, {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        lists.setdefault(r["query_id"], []).append(r["vec_id"])
        scores.setdefault(r["query_id"], []).append(r["score"])
    assert all(s == sorted(s, reverse=True) for s in scores.values())
    return lists


def odd_rows():
    rng = np.random.default_rng(0)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(400)]
    rows += [(1_000 + i, rows[7][1]) for i in range(300)]  # copies, among them queries
    rows += [(2_000, None), (2_050, []), (2_100, [0.0] * 8), (2_150, [float("nan")] + [1.0] * 7), (2_200, [float("inf")] + [1.0] * 7),
             (2_250, [None] + [1.0] * 7), (None, [1.0] * 8), (2_300, [1.0] * 5), (3_000, [1e-30] * 8), (3_050, [1e30] * 8)]
    return rows + [rows[0], rows[0]]


def test_exact_on_small_data_with_copies_and_odd_vectors(spark):
    rows = odd_rows()
    df = table(spark, rows)
    assert found(ann.search(df, F.col("vec_id") % 50 == 0)) == brute(rows)


def test_crowded_cells_are_cut(spark, monkeypatch):
    monkeypatch.setattr(ann, "ENTRIES", 30)
    monkeypatch.setattr(ann, "QUERIES", 3)
    rows = odd_rows()
    df = table(spark, rows)
    assert found(ann.search(df, F.col("vec_id") % 50 == 0)) == brute(rows)


def test_few_and_no_rows(spark):
    df = table(spark, [(0, [1.0] * 8), (1, [1.0] * 7 + [2.0]), (2, [-1.0] * 8)])
    assert found(ann.search(df, F.col("vec_id") % 50 == 0)) == {0: [1, 2]}
    assert ann.search(table(spark, []), F.col("vec_id") % 50 == 0).count() == 0
    alone = table(spark, [(0, [1.0] * 8)])
    assert ann.search(alone, F.col("vec_id") % 50 == 0).count() == 0


def test_walk_visits_every_pair_in_order():
    rng = np.random.default_rng(1)
    for rows, columns in ((1, 1), (1, 6), (7, 9)):
        a, b = rng.normal(size=rows).round(1), rng.normal(size=columns).round(1)
        pairs = list(ann.walk(a, b))
        sums = [a[i] + b[j] for i, j in pairs]
        assert len(set(pairs)) == len(pairs) == rows * columns and np.all(np.diff(sums) >= -1e-12)


@pytest.mark.parametrize("spread", [0.15, 10.0])
def test_recall(spark, spread):
    """With structure, and without any."""
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(40, 8))
    rows = [(i, (centres[i % 40] + spread * rng.normal(size=8)).tolist()) for i in range(4_000)]
    df = table(spark, rows)
    got, want = found(ann.search(df, F.col("vec_id") % 50 == 0)), brute(rows)
    assert np.mean([len(set(got[q]) & set(want[q])) / 5 for q in want]) >= 0.9
