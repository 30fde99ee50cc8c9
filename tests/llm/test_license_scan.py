import pytest

from linderos.llm import license_scan as s

from .conftest import documents, empty

PROSE = ["the old harbour lay quiet in the morning and nobody spoke of the letter", "she counted the boats twice before the bell rang over the water",
         "a driver license was renewed at the office in the city", "rights of way were reserved for the farmers of the valley",
         "the commons were free for the public to use in the summer months"]


@pytest.fixture(scope="module")
def model():
    return s.train([s.words_of(p) for p in PROSE] * 40)


def families(text, model):
    return [x[0] for x in s.scan([text], model)[0][2]]


def test_templates_are_found(model):
    for family, texts in s.TEMPLATES.items():
        for text in texts:
            assert family in families(text, model)


def test_two_notices_on_one_line(model):
    assert families("Copyright 2020 A. Author. All rights reserved. Licensed under the Apache License, Version 2.0.", model) == ["apache", "proprietary"]
    assert sorted(families("Licensed under the Apache License, Version 2.0, or the MIT license.", model)) == ["apache", "mit"]
    both = "This work is licensed under the GNU General Public License, version 3, or the GNU Affero General Public License, version 3."
    assert sorted(families(both, model)) == ["agpl", "gpl"]


WRAPPED = """{before}This program is free software: you can redistribute it and/or modify
it under the terms of the GNU {name} as published
by the Free Software Foundation, either version 3 of the License.
"""


def test_wrapped_notices(model):
    for before in ("", "Prose: a tool of the harbour office\n", PROSE[0] + "\n\n"):
        assert families(WRAPPED.format(before=before, name="General Public License"), model) == ["gpl"]
        assert families(WRAPPED.format(before=before, name="Affero General Public License"), model) == ["agpl"]
        assert families(WRAPPED.format(before=before, name="Lesser General Public License"), model) == ["lgpl"]
    text = PROSE[0] + "\nReleased under\nthe MIT\nLicense.\n" + PROSE[1]
    (family, start, end, _, _), = s.scan([text], model)[0][2]
    assert (family, text[start:end]) == ("mit", "Released under\nthe MIT\nLicense")
    assert families("Released under the\n\nMIT License.", model) == []


def test_words_that_several_families_have_name_none(model):
    n, unconfirmed, spans = s.scan(["This program is free software: you can redistribute it and/or modify"], model)[0]
    assert (n, unconfirmed, spans) == (1, 1, [])


def test_training_windows_do_not_depend_on_the_layout(spark, monkeypatch):
    monkeypatch.setattr(s, "SAMPLE_DOCS", 20)
    monkeypatch.setattr(s, "SAMPLE_WINDOWS", 30)
    given = [(i, f"\n\nfirst{i} line\n" + " ".join(f"w{i}x{k}" for k in range(5_000))) for i in range(60)] + [(60, None), (61, "")]
    frame = documents(spark, given)
    one = s.corpus_windows(frame.coalesce(1).orderBy("doc_id"))
    assert one == s.corpus_windows(frame.repartition(7).sortWithinPartitions(s.F.desc("doc_id"))) and len(one) == 30
    places = [(int(w[-1][1:].split("x")[0]), int(w[-1].split("x")[1])) for w in one if "x" in w[-1]]
    assert len({i for i, _ in places}) >= 19 and any(k > 4_000 for _, k in places)


def test_texts_are_not_joined_with_each_other(model):
    assert [found[2] for found in s.scan(["Released under the", "MIT License.", ""], model)] == [[], [], []]


def test_inside_long_lines(model):
    long = " ".join(PROSE)
    assert families(f"{long} {long} Released under the MIT License. {long}", model) == ["mit"]


def test_prose_is_unknown(model):
    assert [families(p, model) for p in PROSE] == [[]] * len(PROSE)


def test_words_of_a_template_in_another_order_are_not_confirmed(model):
    assert families("Version License Apache the under Licensed 2 0", model) == []


def test_spans_are_code_points(model):
    text = "é é\n" + PROSE[0] + "\nAll rights reserved.\n"
    (family, start, end, probability, alike), = s.scan([text], model)[0][2]
    assert (family, text[start:end]) == ("proprietary", "All rights reserved") and s.LEAST <= probability <= 1 and alike >= s.CONFIRM


def test_windows_cover_every_word():
    import numpy as np

    ids = np.ones(205, dtype=np.uint64)
    ids[[3, 4, 60]] = 0
    start, end = s.paragraphs(ids)
    assert (end - start <= s.WINDOW).all()
    assert sorted({w for a, b in zip(start, end) for w in range(a, b)}) == [i for i in range(205) if ids[i]]


def test_rows(spark, model):
    given = [(1, None), (2, ""), (3, "All rights reserved."), (3, "All rights reserved."), (None, "x"), (4, "word " * 50_000 + "\nReleased under the MIT License.")]
    got = sorted(((r["doc_id"], [x["family"] for x in r["spans"]]) for r in s.scan_documents(documents(spark, given), model).collect()), key=repr)
    assert got == sorted([(1, []), (2, []), (3, ["proprietary"]), (3, ["proprietary"]), (None, []), (4, ["mit"])], key=repr)
    assert s.scan_documents(empty(spark)).count() == 0
    trained = s.scan_documents(documents(spark, given)).collect()
    assert len(trained) == len(given)
