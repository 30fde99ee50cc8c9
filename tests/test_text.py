"""Text helpers against SQLite's own conversions, which define the expected text."""

import sqlite3

import pytest
from pyspark.sql import functions as F

from linderos.functions.text import ascii_upper, blank, labelled, lead_int, or_null, real_text, rounded_text
from linderos.functions.tolerance import out_of_tolerance

REALS = [0.0, 1.0, -2.5, 12345678.0, 0.1 + 0.2, 1234567.891, 1e15, 1e14, 123456789012345.6, 4e-6, 1e-4, 0.00012345, 2 / 3, -7e20, None]
TEXTS = ["A1", "1A", "", " 7", "-3", "07", "+5x", "   ", None]


@pytest.fixture(scope="module")
def lite():
    return sqlite3.connect(":memory:")


def test_real_text(spark, lite):
    df = spark.createDataFrame([(x,) for x in REALS], "x double")
    got = [r[0] for r in df.select(real_text("x").column()).collect()]
    assert got == [lite.execute("SELECT CAST(? AS TEXT)", (x,)).fetchone()[0] for x in REALS]


def test_rounded_text(spark, lite):
    values = [0.12345, 1.0005, 2.5, 100.0, 0.4449, None]
    df = spark.createDataFrame([(x,) for x in values], "x double")
    got = [r[0] for r in df.select(rounded_text("x", 3).column()).collect()]
    assert got == [lite.execute("SELECT CAST(ROUND(?, 3) AS TEXT)", (x,)).fetchone()[0] for x in values]


def test_lead_int(spark, lite):
    df = spark.createDataFrame([(x,) for x in TEXTS], "x string")
    got = [r[0] for r in df.select(lead_int("x")).collect()]
    assert got == [lite.execute("SELECT CAST(? AS INTEGER)", (x,)).fetchone()[0] for x in TEXTS]


def test_ascii_upper(spark, lite):
    values = ["José ñandú", "abcXYZ"]
    df = spark.createDataFrame([(x,) for x in values], "x string")
    got = [r[0] for r in df.select(ascii_upper("x")).collect()]
    assert got == [lite.execute("SELECT UPPER(?)", (x,)).fetchone()[0] for x in values]


def test_blank_and_labels(spark):
    df = spark.createDataFrame([("  ",), ("\t",), (None,), ("a",)], "x string")
    assert [r[0] for r in df.select(blank("x")).collect()] == [True, False, True, False]
    shown = df.select(labelled(("a=", F.col("x")), (" b=", or_null("x")), " end").column()).collect()
    assert [r[0] for r in shown][2:] == ["a= b=NULL end", "a=a b=a end"]


def test_tolerance_is_strict(spark):
    rows = [(12.0, 10.0, False), (12.01, 10.0, True), (630.0, 600.0, False), (630.1, 600.0, True), (None, 2.0, False),
            (None, 2.1, True), (502.0, 500.0, False), (None, None, False)]
    df = spark.createDataFrame(rows, "a double, b double, want boolean")
    assert all(r[0] == r[1] for r in df.select(out_of_tolerance(F.col("a"), F.col("b")), "want").collect())
