import random
from collections import defaultdict

import numpy as np
import pytest

from linderos.llm import near as n

from .conftest import documents, empty


def corpus():
    """Copies, near copies in chains and crowds, boilerplate that is not enough, and odd texts."""
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    base = [word() for _ in range(120)]
    rows = []
    for i in range(90):  # a crowd around one text
        w = list(base)
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(len(w))] = word()
        rows.append((1_000 + i, " ".join(w)))
    w = [word() for _ in range(150)]
    for i in range(25):  # a chain that drifts
        w = list(w)
        w[(i * 6) % 150] = word()
        rows.append((2_000 + i, " ".join(w)))
    shared = " ".join(word() for _ in range(30))
    rows += [(3_000 + i, shared + " " + " ".join(word() for _ in range(40))) for i in range(20)]
    rows += [(10, None), (11, ""), (12, "!!!"), (13, "two words"), (14, "Two, WORDS"), (15, "two other"), (13, "two words"), (None, rows[0][1])]
    rows += [(16, "copy " * 40), (17, "copy " * 40), (18, "alone " + " ".join(word() for _ in range(20_000)))]
    return rows


def brute(rows):
    """(doc_id, group's smallest id, links) of each row, from the definition, over all rows that share a shingle."""
    sets = [frozenset(n.shingles(t).tolist()) for _, t in rows]
    holders = defaultdict(list)
    for i, s in enumerate(sets):
        for g in s:
            holders[g].append(i)
    linked = []
    for i, s in enumerate(sets):
        common = defaultdict(int)
        for g in s:
            for j in holders[g]:
                common[j] += 1
        near = {j for j, c in common.items() if c >= 0.8 * (len(s) + len(sets[j]) - c) - 1e-9}
        linked.append((near or {j for j, o in enumerate(sets) if not o}) - {i})
    group = list(range(len(rows)))
    for _ in rows:
        new = [min([group[i], *(group[j] for j in linked[i])]) for i in range(len(rows))]
        if new == group:
            break
        group = new
    heads = defaultdict(list)
    for i, g in enumerate(group):
        if rows[i][0] is not None:
            heads[g].append(rows[i][0])
    return sorted(((rows[i][0], min(heads[group[i]]), len(linked[i])) for i in range(len(rows))), key=repr)


@pytest.mark.parametrize("cell", [512, 16])
def test_groups_and_links_are_exact(spark, cell):
    got = n.near_groups(documents(spark, corpus()), cell=cell)
    assert sorted(((r["doc_id"], r["class_id"], r["n_links"]) for r in got.collect()), key=repr) == brute(corpus())


def test_one_of_each_group_stays(spark):
    rows = corpus()
    docs = documents(spark, rows)
    kept = n.keep_one(docs)
    assert kept.columns == docs.columns
    want = sorted({head for _, head, _ in brute(rows)})
    assert sorted(r["doc_id"] for r in kept.collect()) == want


def test_empty_table(spark):
    assert n.near_groups(empty(spark)).count() == 0 and n.keep_one(empty(spark)).count() == 0


def test_posterior_by_integration():
    """P(s >= t) under Beta(m + 1, k - m + 1), summed on a fine grid, is below the tolerance exactly where pairs go."""
    s = (np.arange(200_000) + 0.5) / 200_000
    for k, least in n.least_matches().items():
        def tail(m):
            density = np.exp(m * np.log(s) + (k - m) * np.log(1 - s) - (m * np.log(0.8) + (k - m) * np.log(0.2)))
            return density[s >= 0.8].sum() / density.sum()
        assert tail(least) >= n.TOLERANCE * 0.99 and (least == 0 or tail(least - 1) < n.TOLERANCE)


def test_minhash_estimates_similarity():
    a, b = (n.shingles(" ".join(f"w{i}" for i in range(k, k + 400))) for k in (0, 40))
    true = len(set(a) & set(b)) / len(set(a) | set(b))
    assert abs((n.minhashes(a) == n.minhashes(b)).mean() - true) < 0.12


def test_components_against_union(spark):
    rng = random.Random(6)
    edges = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(220)] + [(i, i + 1) for i in range(400, 440)]
    got = dict(tuple(r) for r in n.components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect())
    label = {x: x for e in edges for x in e}
    for _ in label:
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    assert got == {x: v for x, v in label.items() if any(x in e and e[0] != e[1] for e in edges)}
