import math
from itertools import product

import numpy as np
import pytest

from linderos.llm import lattice
from linderos.llm.queries import QUERIES
from tests.conftest import SMALL

SCHEMA = "vec_id long, embedding array<double>, entry long, cell int, a string, v binary"


def table(spark, vectors, ids=None, schema=SCHEMA):
    ids = range(len(vectors)) if ids is None else ids
    return spark.createDataFrame([(i, v, 1, 2, "a", b"v") for i, v in zip(ids, vectors)], schema)


def plain(vectors, link=0.9):
    """n_links and component (smallest place) of each vector, by all pairs."""
    def usable(v):
        return bool(v) and all(c is not None and math.isfinite(c) for c in v) and any(v)

    n, root, links = len(vectors), list(range(len(vectors))), [0] * len(vectors)

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    units = [np.array(v) / np.abs(v).max() if usable(v) else None for v in vectors]
    for i in range(n):
        for j in range(i):
            a, b = units[i], units[j]
            if a is not None and b is not None and len(a) == len(b) and a @ b / math.sqrt(a @ a) / math.sqrt(b @ b) >= link:
                links[i] += 1
                links[j] += 1
                x, y = sorted((top(i), top(j)))
                root[y] = x
    return [(links[i], top(i)) for i in range(n)]


def found(df):
    return [(r["n_links"], r["component_id"]) for r in sorted(df.collect(), key=lambda r: r["vec_id"])]


def clustered(rng, groups, size, width, spread):
    out = []
    for _ in range(groups):
        centre = rng.standard_normal(width)
        centre /= np.linalg.norm(centre)
        out += [centre + spread * rng.standard_normal(width) / math.sqrt(width) for _ in range(size)]
    return [v.tolist() for v in out]


def test_decoding_finds_the_nearest_lattice_point():
    rng = np.random.default_rng(1)
    y = rng.standard_normal((200, 8)) * 2
    point = lattice.nearest_e8(y)
    doubled = np.rint(2 * point).astype(int)
    assert (doubled == 2 * point).all() and (np.ptp(doubled % 2, axis=1) == 0).all() and (point.sum(axis=1) % 2 == 0).all()
    assert len(lattice.MINIMAL) == 240 and np.allclose((lattice.MINIMAL**2).sum(axis=1), 2)
    around = [np.array(p) for p in product((-1.0, 0.0, 1.0), repeat=8)]
    around += [np.array(p) for p in product((-1.5, -0.5, 0.5, 1.5), repeat=8)]
    steps = np.array([p for p in around if p.sum() % 2 == 0 and (p**2).sum() <= 4])
    own = ((y - point) ** 2).sum(axis=1)
    assert (own[:, None] <= (((y - point)[:, None, :] - steps[None, :, :]) ** 2).sum(axis=2) + 1e-9).all()


def test_probes_are_the_nearest_neighbouring_cells():
    y = np.random.default_rng(2).standard_normal((50, 8)) * 1.5
    codes = lattice.probed_cells(y, np.uint64(5), 4)
    assert all(len(set(c)) == 4 for c in codes.tolist())
    near = lattice.nearest_e8(y)
    for k in range(50):
        ranked = sorted(lattice.MINIMAL, key=lambda v: ((y[k] - near[k] - v) ** 2).sum())[:3]
        wanted = {int(lattice.probed_cells((near[k] + v)[None], np.uint64(5), 1)[0, 0]) for v in [np.zeros(8), *ranked]}
        assert wanted == set(codes[k].tolist())


def test_plan_keeps_the_promised_share():
    for n in (2, 1_000, 1_000_000):
        plan = lattice.plan_for(n)
        assert (1 - lattice.meeting_share(plan.blocks, plan.scale)) ** plan.tables <= lattice.MISS


@pytest.mark.parametrize("block", [lattice.BLOCK, 8])
def test_links_are_those_of_all_pairs(spark, block):
    rng = np.random.default_rng(3)
    vectors = clustered(rng, 6, 40, 24, 0.35) + clustered(rng, 30, 3, 24, 0.2) + rng.standard_normal((60, 24)).tolist()
    vectors += [vectors[0]] * 20 + [[2 * c for c in vectors[1]]]
    wanted = plain(vectors)
    assert len({n for n, _ in wanted}) > 10
    assert found(lattice.near_vectors(table(spark, vectors), block=block)) == wanted


def test_pairs_around_the_threshold(spark):
    rng, vectors = np.random.default_rng(4), []
    for k in range(150):
        a, b = np.linalg.qr(rng.standard_normal((16, 2)))[0].T
        c = 0.9 + (k - 75) * 1e-3
        vectors += [a.tolist(), (c * a + math.sqrt(1 - c * c) * b).tolist()]
    assert found(lattice.near_vectors(table(spark, vectors))) == plain(vectors)


def test_query_links_what_all_pairs_link(spark):
    rows = spark.read.parquet(f"{SMALL}/embeddings.parquet").collect()
    vectors = [r["embedding"] for r in sorted(rows, key=lambda r: r["vec_id"])]
    assert found(QUERIES["op12_embedding_near_dedup"](spark, SMALL)) == plain(vectors)


def test_vectors_that_cannot_link_are_alone(spark):
    one = [1.0, 0.0, 0.0]
    vectors = [None, [], [0.0, 0.0, 0.0], [1.0, None, 0.0], [float("nan"), 1.0, 0.0], [float("inf"), 0.0, 0.0], [1.0, 0.0], one, one, [-0.0, 5e-324, 0.0], [1e300, 0.0, 1e290]]
    assert found(lattice.near_vectors(table(spark, vectors))) == plain(vectors)
    assert lattice.near_vectors(table(spark, [])).collect() == []
    assert [tuple(r)[:4] for r in lattice.near_vectors(table(spark, [None])).collect()] == [(0, 0, 0, True)]


def test_ids_of_any_kind(spark):
    one, big = [1.0, 2.0], 1 << 60
    rows = lattice.near_vectors(table(spark, [one, one, one, None], [big + 1, None, big + 3, None])).collect()
    assert sorted((str(r["vec_id"]), r["n_links"], str(r["component_id"]), r["kept"]) for r in rows) == sorted([
        (str(big + 1), 2, str(big + 1), True), (str(big + 3), 2, str(big + 1), False), ("None", 2, str(big + 1), False), ("None", 0, "None", False)])
    repeated = lattice.near_vectors(table(spark, [one, one], [7, 7])).collect()
    assert [tuple(r)[:4] for r in repeated] == [(7, 1, 7, True)] * 2
    named = lattice.near_vectors(table(spark, [one, one], ["b", "a"], SCHEMA.replace("vec_id long", "vec_id string")))
    assert {(r["vec_id"], r["component_id"]) for r in named.collect()} == {("a", "a"), ("b", "a")}
