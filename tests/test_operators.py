"""Operators against brute force on small fixtures."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from conftest import bag
from linderos.operators.areas import polygon_area
from linderos.operators.parties import same_name_diff_id
from linderos.operators.relations import exists_in, unique
from linderos.operators.skew import attach_many, grid_join, grid_sizes, half_grid_join, join_many, repeat_rows


@pytest.fixture(scope="module")
def many(spark):
    random.seed(5)
    rows = [(i, 7 if i % 3 == 0 else None if i % 5 == 0 else random.randint(0, 12)) for i in range(300)]
    return spark.createDataFrame(rows, "id long, k long")


@pytest.fixture(scope="module")
def one(spark):
    return spark.createDataFrame([(i, f"v{i}") for i in (1, 2, 3, 7, 20)], "key long, v string")


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_join_many(many, one, how):
    values = {r.key: r.v for r in one.collect()}
    rows = [tuple(r) for r in many.collect()]
    want = {
        "inner": [(*r, values[r[1]]) for r in rows if r[1] in values], "left": [(*r, values.get(r[1])) for r in rows],
        "left_semi": [r for r in rows if r[1] in values], "left_anti": [r for r in rows if r[1] not in values],
    }
    assert bag(join_many(many, one, ("k", "key"), how).collect()) == bag(want[how])


def test_attach_many_is_an_outer_join(many, one):
    rows = [tuple(r) for r in many.collect()]
    want = [(r.key, r.v, i) for r in one.collect() for i in [i for i, k in rows if k == r.key] or [None]]
    assert bag(attach_many(one, many, ("key", "k")).select("key", "v", "id").collect()) == bag(want)


@pytest.mark.parametrize("cell", [4, 2_000])
def test_grid_join_gives_every_pair_once(spark, many, cell):
    other = many.filter("id % 4 = 0").select(F.col("id").alias("other_id"), F.col("k").alias("other_k"))
    sizes = grid_sizes(many, other, ("k", "other_k"), cell)
    got = grid_join(many, other, ("k", "other_k"), ("id", "other_id"), sizes).select("id", "other_id")
    rows = [tuple(r) for r in many.collect()]
    assert bag(got.collect()) == bag((a, b) for a, x in rows for b, y in rows if b % 4 == 0 and x is not None and x == y)


def test_cells_of_a_frequent_key_are_even(spark):
    """A name that everybody bears makes cells of bounded size."""
    people = spark.range(6_000).select("id", F.lit("ana").alias("k"))
    sizes = grid_sizes(people, people, ("k", "k"), 500)
    assert [tuple(r) for r in sizes.collect()] == [("ana", 12, 12)]
    placed = people.groupBy(F.pmod(F.xxhash64("id"), F.lit(12))).count().agg(F.max("count")).first()[0]
    assert placed < 2 * 500


def test_unique_and_exists(many, one):
    count = {}
    rows = many.collect()
    for r in rows:
        count[r.k] = count.get(r.k, 0) + 1
    assert bag(unique(many, "k").collect()) == bag(r for r in rows if r.k is not None and count[r.k] > 1)
    keys = {r.key for r in one.collect()}
    assert bag(exists_in(many, "k", one, "key", negate=True).collect()) == bag(r for r in rows if r.k not in keys)


def test_repeat_rows_in_chunks(spark):
    df = spark.createDataFrame([("a", 0), ("b", 1), ("c", 7), ("d", 3)], "x string, n int")
    got = repeat_rows(df, F.col("n"), chunk=3).groupBy("x").count().collect()
    assert bag(got) == [("b", 1), ("c", 7), ("d", 3)]


def shoelace(points):
    return abs(sum(x1 * y2 - x2 * y1 for (x1, y1), (x2, y2) in zip(points, points[1:] + points[:1]))) / 2


@pytest.mark.parametrize("segment", [1, 3, 10_000])
def test_polygon_area(spark, segment):
    random.seed(1)
    rings = {(1, 0): [(0, 0), (4, 0), (4, 3), (0, 3)], (1, 1): [(1, 1), (1, 2), (2, 2), (2, 1)],
             (2, 0): [(random.random(), random.random()) for _ in range(17)]}
    rows = [(uc, ring, 5 * i + 2, float(x), float(y)) for (uc, ring), points in rings.items() for i, (x, y) in enumerate(points)]
    random.shuffle(rows)
    got = dict(map(tuple, polygon_area(spark.createDataFrame(rows, "uc_id long, ring int, seq int, x double, y double"), segment).collect()))
    assert got[1] == pytest.approx(11.0)
    assert got[2] == pytest.approx(shoelace(rings[2, 0]))


@pytest.mark.parametrize("cell", [3, 2_000])
def test_homonym_pairs(spark, cell):
    random.seed(3)
    names = ["Ana", " ana ", "ANA", "Eva", "José", "JOSÉ", "   ", "", None]
    rows = [(i, random.choice(["1", "2", "3", None]), random.choice(names), random.choice([None, "Eva"])) for i in range(60)]

    def raw(r):
        return r[2] if r[2] is not None else r[3]

    def key(r):
        return "".join(c.upper() if c.isascii() else c for c in (raw(r) or "").strip(" "))

    want = [
        (a[0], raw(a), a[1], b[0], b[1]) for a, b in itertools.product(rows, rows)
        if a[0] < b[0] and key(a) == key(b) and (raw(a) or "") != "" and a[1] and b[1] and a[1] != b[1]
    ]
    df = spark.createDataFrame(rows, "interesado_id long, numero_documento string, nombre_interesado string, razon_social string")
    assert bag(same_name_diff_id(df, cell).collect()) == bag(want)


def _exact_area(rings):
    """Outer rings minus holes in exact arithmetic; rings are (is hole, vertices)."""
    from fractions import Fraction

    total = Fraction(0)
    for hole, points in rings:
        p = [(Fraction(x), Fraction(y)) for x, y in points]
        own = abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(p, p[1:] + p[:1]))) / 2
        total += -own if hole else own
    return float(total)


def test_polygon_area_on_national_grid_coordinates(spark):
    """Areas to a square millimetre where products of raw coordinates lose tenths of a square metre; several polygons and
    holes in a unit, rings over many segments, gaps in the order."""
    import random

    from linderos.operators.areas import polygon_area

    rng = random.Random(4)
    rows, want = [], {}
    for uc in range(60):
        rings = []
        for part in range(1 + uc % 3):
            x0, y0 = 4_880_000 + rng.random() * 1e5, 2_070_000 + rng.random() * 1e5
            for ring in range(1 + uc % 2):
                n, size = rng.choice([3, 4, 7, 40]), rng.uniform(1, 30) / (ring + 1)
                import math
                points = [(x0 + size * math.cos(2 * math.pi * k / n), y0 + size * math.sin(2 * math.pi * k / n)) for k in range(n)]
                rings.append((ring > 0, points))
                rows += [(uc, part, ring, 3 * k, x, y) for k, (x, y) in enumerate(points)]
        want[uc] = _exact_area(rings)
    rng.shuffle(rows)
    table = spark.createDataFrame(rows, "uc_id long, parte int, ring int, seq int, x double, y double")
    for segment in (10_000, 8, 3):
        found = {r["uc_id"]: r["area_geo"] for r in polygon_area(table, segment).collect()}
        assert found.keys() == want.keys() and max(abs(found[u] - want[u]) for u in want) < 1e-6
    shuffled = polygon_area(table.repartition(7, "seq"), 8).collect()
    assert {r["uc_id"]: r["area_geo"] for r in shuffled} == {r["uc_id"]: r["area_geo"] for r in polygon_area(table, 8).collect()}


def test_polygon_area_of_wild_coordinates(spark):
    from linderos.operators.areas import polygon_area

    rows = [(1, 0, 0, 0.0, 0.0), (1, 0, 1, 1e15, 0.0), (1, 0, 2, 1e15, 1e15), (1, 0, 3, 0.0, 1e15), (2, 0, 0, 5.0, 5.0), (3, 0, 0, 1.0, None), (3, 0, 1, 2.0, 1.0)]
    found = dict(tuple(r) for r in polygon_area(spark.createDataFrame(rows, "uc_id long, ring int, seq int, x double, y double")).collect())
    assert found[1] == 1e30 and found[2] == 0.0 and set(found) == {1, 2, 3}


def test_cells_are_not_merged_by_their_bytes(spark, many):
    """AQE sees small inputs; the pairs are spread all the same."""
    from linderos.operators.skew import CELL_SPREAD

    left, right = spark.range(300).select(F.lit(1).alias("a"), F.col("id").alias("i")), spark.range(300).select(F.lit(1).alias("b"), F.col("id").alias("j"))
    pairs = grid_join(left, right, ("a", "b"), ("i", "j"), grid_sizes(left, right, ("a", "b"), 20))
    assert pairs.count() == 90_000
    assert pairs.rdd.getNumPartitions() == CELL_SPREAD * int(spark.conf.get("spark.sql.shuffle.partitions"))
    busy = pairs.groupBy(F.spark_partition_id().alias("p")).count()
    assert busy.count() > int(spark.conf.get("spark.sql.shuffle.partitions"))


@pytest.mark.parametrize("slots", [1, 4])
def test_half_grid_builds_a_pair_once(spark, slots):
    rows = [(i % 25 if i % 11 else None, "nkm"[i % 3]) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, k string")
    sizes = spark.createDataFrame([("n", slots, True), ("m", slots, False)], "_key string, _rows int, _same boolean")
    built = half_grid_join(df.toDF("x", "xk"), df.toDF("y", "yk"), ("xk", "yk"), ("x", "y"), sizes).select("x", "y", "xk")
    got = [tuple(r) for r in built.collect()]
    want = [(a, b, k) for (a, k), (b, other) in itertools.product(rows, rows) if k == other != "k" and a is not None and b is not None and a < b]
    assert bag((min(a, b), max(a, b), k) for a, b, k in got) == bag(want)
    assert all(a < b for a, b, k in got if k == "m")
