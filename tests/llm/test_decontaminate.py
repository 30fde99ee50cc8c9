import re

import pytest
from pyspark.sql import functions as F

from linderos.llm import decontaminate as d, oracle
from linderos.llm.queries import op3_benchmark_decontamination

from .conftest import LONG_WORDS, documents, empty

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(text, items, n=10):
    w, hit, found = words(text), set(), set()
    for item_id, item in items:
        own = words(item)
        k = min(n, len(own))
        for i in range(len(own) - k + 1) if k else ():
            for at in range(len(w) - k + 1):
                if w[at:at + k] == own[i:i + k]:
                    hit.update(range(at, at + k))
                    found.add(item_id)
    return len(w), len(hit), found


ITEMS = [(1, "One two three four five six seven eight nine ten eleven"), (2, "short ITEM"), (3, None), (4, "..."), (5, "two three four five six seven eight nine ten eleven")]
TEXTS = [
    (1, "x ONE two, three four five six seven eight nine ten y"), (2, "a short item. Short item"), (3, None), (4, ""), (5, "!!!"),
    (6, "clean text without anything"), (6, "short item under the same id"), (6, "short item under the same id"), (None, "ÉCOLE short\x00item é"),
    (7, "one two three four five six seven eight nine ten eleven " * 3 + "w " * LONG_WORDS),
]


def benchmark(spark, rows=ITEMS):
    return spark.createDataFrame([(i, t, "x") for i, t in rows], "item_id long, text string, key string")


@pytest.mark.parametrize("per_block", [1_000_000, 2])
def test_against_brute_force(spark, per_block):
    got = []
    for r in d.contamination(documents(spark, TEXTS), benchmark(spark), windows_per_block=per_block).collect():
        got += [(r["doc_id"], r["n_words"], r["n_hit"], tuple(sorted(r["items"])))] * r["copies"]
    want = [(i, n, h, tuple(sorted(f))) for i, t in TEXTS for n, h, f in [brute(t, ITEMS)]]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_empty_sides(spark):
    assert d.contamination(empty(spark), benchmark(spark)).count() == 0
    nothing = d.contamination(documents(spark, TEXTS), benchmark(spark, [])).agg(F.sum("n_hit"), F.sum("copies")).first()
    assert tuple(nothing) == (0, len(TEXTS))


def test_filters_keep_columns_and_clean_rows(spark):
    docs = documents(spark, TEXTS)
    kept = d.drop_contaminated(docs, benchmark(spark))
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [3, 4, 5, 6]
    cut = {r["text"] for r in d.remove_spans(docs, benchmark(spark)).collect()}
    assert "a " in cut and "x y" in cut and "clean text without anything" in cut and None in cut
    assert all(not brute(t, ITEMS)[1] for t in cut)


def test_no_python_and_one_scan(spark):
    docs = documents(spark, TEXTS)
    keyed, lengths, seed, count = d.keyed_windows(benchmark(spark))
    plan = d.scan(docs, keyed, lengths[-1:], seed, count)._jdf.queryExecution().toString()
    assert "BroadcastHashJoin" in plan and "Python" not in plan and "Cartesian" not in plan


def test_whole_table_against_sql(spark, duck):
    folder = "/root/testdata/sf0.001"
    for name in ("documents", "benchmark"):
        duck.sql(f"CREATE OR REPLACE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    df = op3_benchmark_decontamination(spark, folder)
    found = duck.sql(oracle.OP3)
    order = [found.columns.index(c) for c in df.columns]
    assert sorted(tuple(r[i] for i in order) for r in found.fetchall()) == sorted(tuple(r) for r in df.collect())
