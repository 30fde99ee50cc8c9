"""Tables made of lines: the same rows as in the portable SQL, and one shuffle of the lines for all of them."""

from conftest import bag
from linderos.sources import sample

LINES = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double"


def rows():
    """Repeated (order, line) pairs, lines that are equal throughout, and nulls."""
    found = [(k, 7 * k % 5, k % 3, 1 + k % 4, float(k % 9), 1000.5 + 37 * k) for k in range(60)]
    found += [(k, 3, 1, 1 + k % 4, float(k % 4), 90.25) for k in range(0, 60, 5)] * 2
    return found + [(None, 1, 1, 1, 3.0, 10.0), (4, None, 1, None, 3.0, 10.0), (8, 2, None, 1, None, None), (8, 2, None, 1, 5.0, None)]


def test_lines_are_numbered_alike(spark):
    lines = spark.createDataFrame(rows(), LINES)
    plain, late = (spark.sql(text, lineitem=lines) for text in (sample._LINE_BASE, sample._LINE_BASE_SPARK))
    assert plain.dtypes == late.dtypes and bag(plain.collect()) == bag(late.collect())
    assert all(sample._LINE_BASE not in text for text in sample.sample_sql("spark").values())
    assert all(sample._LINE_BASE_SPARK not in text for text in sample.sample_sql("duckdb").values())


def test_tables_of_lines_share_their_shuffle(spark, tmp_path):
    """Units, traits and vertices (RF-21) read one exchange of the lines."""
    path = str(tmp_path / "lineitem.parquet")
    spark.createDataFrame(rows(), LINES).write.parquet(path)
    lines, texts = spark.read.parquet(path), sample.sample_sql("spark")
    units, traits, vertices = (
        spark.sql(texts[name], lineitem=lines) for name in ("cca_unidadconstruccion", "cca_caracteristicaucons", "uc_vertices"))
    drawn = vertices.groupBy("uc_id").count()
    both = units.join(traits, units["caracteristica"] == traits["T_Id"]).join(drawn, units["T_Id"] == drawn["uc_id"])
    given = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = both.select("predio", "identificador", "area_construida", "count")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", given)
    assert plan.count("Window [") == 3 and plan.count("FileScan") == 1
