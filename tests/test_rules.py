"""The catalogue against DuckDB on the projected sample."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as driver
from conftest import SMALL, bag
from linderos.plans.findings import rule_findings
from linderos.plans.frames import SHARED
from linderos.plans.run import shared_once, violations
from linderos.rules import catalogue, categories, select_rules
from linderos.sources.tables import Cadastre
from oracle import rules_sql

ONE_PER_FRAME = list({rule.parts[-1].frame: rule for rule in catalogue()}.values())


def expected(duck, sql, columns):
    found = duck.sql(sql)
    order = [found.columns.index(c) for c in columns]
    return bag(tuple(row[i] for i in order) for row in found.fetchall())


@pytest.fixture(scope="module")
def all_expected(duck):
    columns = ["regla_id", "regla_descripcion", "categoria", "severidad", "tabla", "t_id", "clave_negocio", "mensaje", "valor_actual", "valor_esperado"]
    return columns, expected(duck, rules_sql.violations_sql(), columns)


def test_catalogue():
    rules = catalogue()
    assert len(rules) == len({r.id for r in rules}) == 123
    assert sum(r.severidad == "error" for r in rules) == 94
    assert categories() == sorted(["coherencia_geografica", "destinacion_uso", "duplicados", "fisicas", "juridicas", "novedades",
                                   "numero_predial", "ph_condominio", "registral", "terreno"])
    assert {r.id for r in select_rules(["registral"], ["error"])} == {"R-24-A", "R-24-B"}
    assert {r.id for r in select_rules(["coherencia_geografica"])} == {"R-15", "R-16"}
    assert len(select_rules([], None)) == 123
    text, _ = driver.text_queries()
    assert set(driver.queries()) - set(text) == set(driver.oracle_sql()) - set(text)


@pytest.mark.parametrize("rule", ONE_PER_FRAME, ids=lambda r: r.id)
def test_single_rule(tables, duck, rule):
    found = rule_findings(tables, rule).select(*driver.FINDING)
    assert bag(found.collect()) == expected(duck, rules_sql.rule_sql(rule.id), found.columns)


def test_fused_run(tables, all_expected):
    columns, want = all_expected
    found, failed = violations(tables, catalogue(), "")
    assert not failed
    assert bag(found.select(*columns).collect()) == want


def test_fused_run_with_skewed_partitions_cut(spark, tables, all_expected):
    """Shuffled joins only, and thresholds low enough for AQE to cut the sample's frequent keys."""
    columns, want = all_expected
    low = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "2k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.1",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4k",
    }
    before = {k: spark.conf.get(k, None) for k in low}
    for k, v in low.items():
        spark.conf.set(k, v)
    try:
        found, failed = violations(tables, catalogue(), "")
        assert not failed
        assert bag(found.select(*columns).collect()) == want
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_fused_run_with_relations_kept(tables, all_expected):
    """Same rows with the shared relations written first, and fewer scans in the plan."""
    columns, want = all_expected
    kept = shared_once(tables, catalogue())
    assert set(kept.kept) == set(SHARED)
    found, failed = violations(kept, catalogue(), "")
    assert not failed
    assert bag(found.select(*columns).collect()) == want
    scans = lambda c: violations(c, catalogue(), "")[0]._jdf.queryExecution().optimizedPlan().toString().count("Relation [")
    assert scans(kept) < scans(tables)


def test_planning_starts_no_job(spark, tables):
    group = "planning"
    spark.sparkContext.setJobGroup(group, group)
    for rule in catalogue():
        rule_findings(tables, rule)
    assert not spark.sparkContext.statusTracker().getJobIdsForGroup(group)
    spark.sparkContext.setJobGroup("", "")


def test_number_pattern_on_nulls_and_short_numbers(spark):
    rows = [(1, "25506" + "0" * 25, "0"), (2, "25506", "0"), (3, None, "0"), (4, "25506" + "0" * 16 + "123456789", "0"), (5, "x", None)]
    from linderos.schema import TABLES

    parcels = spark.createDataFrame(rows, "T_Id long, numero_predial_nacional string, condicion_predio string")
    for field in TABLES["cca_predio"].fields:
        if field.name not in parcels.columns:
            parcels = parcels.withColumn(field.name, F.lit(None).cast(field.dataType))
    (rule,) = [r for r in catalogue() if r.id == "R-01"]
    found = rule_findings(Cadastre(spark, {"cca_predio": parcels}), rule)
    assert bag(found.select("t_id", "valor_actual").collect()) == [(2, ""), (4, "123456789")]
