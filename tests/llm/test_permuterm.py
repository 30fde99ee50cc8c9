import re
import zlib
from collections import Counter

import numpy as np

from linderos.llm import permuterm
from linderos.llm.queries import QUERIES
from tests.conftest import SMALL
from tests.llm.conftest import documents, empty


def plain(rows):
    """The definition: every word against every string one edit away that is a word."""
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}
    holes = {}
    for w in words:
        for k in range(len(w)):
            holes.setdefault((w[:k], w[k + 1:]), set()).add(w)
    near = {w: set() for w in words}
    for w in words:
        for k in range(len(w)):
            near[w] |= holes[w[:k], w[k + 1:]]
            shorter = w[:k] + w[k + 1:]
            if shorter in words:
                near[w].add(shorter)
                near[shorter].add(w)
        near[w].discard(w)
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda o: (-words[o], o), default=None)
        form[w] = best if best is not None and words[best] >= 10 * words[w] else None
    out = []
    for w, n in words.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n, len(near[w]), words[form[w]] if form[w] else None))
    return sorted(out)


def found(df):
    return sorted(tuple(r[c] for c in ("word", "form", "root", "n", "n_near", "form_n")) for r in df.collect())


def test_query_is_the_definition(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    wanted = plain(rows)
    assert found(QUERIES["op13_spelling_variants"](spark, SMALL)) == wanted
    assert sum(r[1] is not None for r in wanted) >= 5 and sum(r[4] > 1 for r in wanted) > 20


def test_words_of_few_letters(spark):
    rng = np.random.default_rng(1)
    rows = []
    for i in range(300):
        words = ["".join(rng.choice(list("aabé"), rng.integers(6, 10))) for _ in range(30)]
        rows.append((i, " ".join(words + ["aaaaaaaa", "bbaaaabb"] * int(rng.integers(0, 20)))))
    wanted = plain(rows)
    assert max(r[4] for r in wanted) > 10 and any(r[1] for r in wanted)
    assert found(permuterm.spelling_variants(documents(spark, rows))) == wanted


def test_chains_of_forms(spark):
    chain = [("x" * k + "abcdefg", 2 * 10**k) for k in range(4)]
    whole = lambda i, w: zlib.crc32(f"{i}:{w}".encode()) % 31
    rows = [(next(i for i in range(99) if whole(i, w)), (w + " ") * n) for w, n in chain]
    wanted = plain(rows)
    assert found(permuterm.spelling_variants(documents(spark, rows))) == wanted
    assert len({r[2] for r in wanted}) == 1


def test_words_beyond_literal_rotations(spark):
    rng = np.random.default_rng(2)
    long = "".join(rng.choice(list("abc"), 500))
    texts = []
    for size in (62, 63, 64, 65, 66, 500):
        w = long[:size]
        variants = [w[:20] + "z" + w[21:], w[:20] + w[21:], w[:9] + "zz" + w[9:], w[:9] + "z" + w[9:], w + "y", "y" + w, w + w[-1], w[0] + w]
        texts += [w] * 45 + variants * 2
    rows = list(enumerate(texts))
    wanted = plain(rows)
    assert sum(r[4] > 0 for r in wanted) > 40 and any(len(r[0]) > 400 and r[1] for r in wanted)
    assert found(permuterm.spelling_variants(documents(spark, rows))) == wanted


def test_a_very_long_word(spark):
    rows = [(k, "ab" * 20_000) for k in range(25)] + [(k, "ab" * 20_000 + "c") for k in range(30, 32)]
    assert found(permuterm.spelling_variants(documents(spark, rows))) == plain(rows)


def test_nulls_blanks_repeats_and_empty_tables(spark):
    rows = [(None, "Abcdefgh abcdefgh"), (None, None), (1, ""), (2, "..."), (2, "ABCDEFGH Étudiant Étudiant"), (2, "ABCDEFGH"), (2, "ABCDEFGH")]
    assert found(permuterm.spelling_variants(documents(spark, rows))) == plain(rows)
    assert found(permuterm.spelling_variants(empty(spark))) == []


def test_worker_tables_are_given_out_when_full(spark, monkeypatch):
    monkeypatch.setattr(permuterm, "KEPT_WORDS", 3)
    batches = documents(spark, [(k, "abcdefg bcdefgh cdefghi defghij " * 2) for k in range(20)]).select("doc_id", "text").selectExpr("string(doc_id)", "text").toArrow().to_batches()
    total = Counter()
    for batch in permuterm._counted(iter(batches)):
        total.update(dict(zip(*[c.to_pylist() for c in batch.columns])))
    assert len(total) >= 4


def test_digests_are_those_of_the_rotations():
    def digest(text):
        value = 0
        for c in text:
            value = (value * permuterm._BASE + ord(c)) % permuterm._PRIME
        return value

    w = "spelling"
    skips, whole = permuterm.digests(w)
    assert skips == [digest(w[k + 1:] + "$" + w[:k]) for k in range(len(w))]
    assert whole == [digest(w[k:] + "$" + w[:k]) for k in range(len(w) + 1)]
