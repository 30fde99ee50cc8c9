import random

import numpy as np
from pyspark.sql import functions as F

from linderos.llm import quality as q
from linderos.llm.queries import op2_quality_classifier

from .conftest import documents, empty


def rows(count):
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9)))
    out = []
    for i in range(count):
        words = [word() for _ in range(rng.randint(20, 80))]
        out.append((i, " ".join(words) + "." if i % 4 else " ".join(w.upper() + "!!" for w in words)))
    return out


def labels(spark, pairs):
    return spark.createDataFrame([(i, y, 0.0) for i, y in pairs], "doc_id long, quality int, stats double")


def test_held_out_rows_are_told_apart(spark):
    given = rows(300) + [(900, None), (901, ""), (None, "some text"), (5, "second text of an id"), (902, "w " * 50_000)]
    marks = [(i, int(i % 4 > 0)) for i in range(300)] + [(3, None), (7, 5), (10_000, 1)]
    got = q.classify(documents(spark, given), labels(spark, marks)).collect()
    assert len(got) == len(given) and all(0 <= r["score"] <= 1 for r in got)
    held = [(r["score"], r["doc_id"] % 4 > 0) for r in got if r["fold"] == 0 and r["doc_id"] is not None and r["doc_id"] < 300]
    assert len(held) > 30 and np.mean([(s >= q.ACCEPT) == y for s, y in held]) > 0.95


def test_labels_of_held_out_rows_are_never_used(spark):
    given = documents(spark, rows(120))
    marks = spark.createDataFrame([(i, int(i % 4 > 0)) for i in range(120)], "doc_id long, quality int")
    held = q.fold_of(F.col("doc_id")) == 0
    turned = marks.withColumn("quality", F.when(held, 1 - F.col("quality")).otherwise(F.col("quality")))
    scores = [{r["doc_id"]: r["score"] for r in q.classify(given, m).collect()} for m in (marks, turned)]
    assert scores[0].keys() == scores[1].keys() and all(abs(scores[0][k] - scores[1][k]) < 1e-6 for k in scores[0])


def test_without_labels_or_documents(spark):
    none = labels(spark, [])
    assert {r["score"] for r in q.classify(documents(spark, rows(5)), none).collect()} == {0.5}
    one = labels(spark, [(i, 1) for i in range(5)])
    assert {r["score"] for r in q.classify(documents(spark, rows(5)), one).collect()} <= {1.0, 0.5}
    assert q.classify(empty(spark), none).count() == 0 and q.keep_good(empty(spark), none).count() == 0


def test_filter_keeps_columns_and_good_rows(spark):
    docs = documents(spark, rows(200))
    kept = q.keep_good(docs, labels(spark, [(i, int(i % 4 > 0)) for i in range(200)]))
    assert kept.columns == docs.columns
    ids = {r["doc_id"] for r in kept.collect()}
    assert len(ids & {i for i in range(200) if i % 4}) > 145 and len(ids & set(range(0, 200, 4))) < 3


def test_isotonic_rates_against_brute_force():
    rng = np.random.default_rng(0)
    x, t = np.arange(12.0), rng.integers(1, 5, 12)
    p = rng.integers(0, t + 1)
    place, rate = q.pool_adjacent_violators(x, p.astype(float), t.astype(float))
    # min-max formula of isotonic regression
    r = [max(min(p[i:j + 1].sum() / t[i:j + 1].sum() for j in range(k, 12)) for i in range(k + 1)) for k in range(12)]
    assert np.allclose(np.unique(np.round(r, 9)), np.unique(np.round(rate, 9))) and (np.diff(rate) >= 0).all() and (np.diff(place) > 0).all()


def test_fourier_features_approximate_the_kernel():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(40, q.STATISTICS)) * 0.8
    z = q.fourier(x, np.zeros(q.STATISTICS), np.ones(q.STATISTICS))[:, :-1]
    distance = ((x[:, None] - x[None]) ** 2).sum(-1)
    assert np.abs(z @ z.T - np.exp(-distance / (2 * q.WIDTH**2))).mean() < 0.06


def test_held_out_accuracy_of_the_query(spark):
    folder = "/root/testdata/sf0.01"
    truth = spark.read.parquet(f"{folder}/labels.parquet").select("doc_id", "quality")
    got = op2_quality_classifier(spark, folder).where("held_out").join(truth, "doc_id").collect()
    assert len(got) > 50 and np.mean([r["predicted"] == r["quality"] for r in got]) > 0.95
