
from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession, functions as F

from linderos.operators.areas import polygon_area as polygon_areas
from linderos.plans.findings import finding_counts, rule_findings
from linderos.plans.frames import FRAMES
from linderos.plans.keyed import keep_shared
from linderos.plans.run import (
    cancel_frame, counts_by_category, counts_by_rule, run_rules, stored_violations, summary_by_severity, summary_of_counts,
    violations,
)
from linderos.plans.sink import ConcurrentWrite, begin, commit, compact, read_violations, rebased, vacuum, write_part
from linderos.rules import Rule, catalogue, select_rules
from linderos.schema import FINDING
from linderos.sources.r1 import R1List, read_r1_csv
from linderos.sources.sample import sample_frames
from linderos.sources.tables import Cadastre
from oracle import rules_sql

SMOKE = "/root/testdata/sf0.001"
NO_TIME = ""

def tables(spark: SparkSession, sf_dir: str) -> Cadastre:
    """The cadastral tables of a sample directory, projected lazily: a query reads only what it needs, nothing is written."""
    return Cadastre(spark, sample_frames(spark, sf_dir))


def key_of(rule_id: str) -> str:
    return rule_id.lower().replace("-", "_")


def one_rule(rule) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return rule_findings(tables(spark, sf_dir), rule).select(*FINDING)

    return run


def all_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every rule over relations that are kept for the run; findings other than pairs of parties are written beside them."""
    folder = _new_folder(spark, "run")
    found, failed = stored_violations(keep_shared(tables(spark, sf_dir), folder), catalogue(), NO_TIME, f"{folder}/hallazgos")
    assert found is not None and not failed, failed
    return found.drop("fecha_validacion")


def _counted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Violations of every rule, counted over the kept relations; pairs of parties are counted from both sides."""
    counts, failed = finding_counts(keep_shared(tables(spark, sf_dir), _new_folder(spark, "run")), catalogue())
    assert counts is not None and not failed, failed
    return counts


def by_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary_of_counts(spark, catalogue(), _counted(spark, sf_dir))


def by_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary_by_severity(by_rule(spark, sf_dir))


def polygon_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    return polygon_areas(tables(spark, sf_dir)["vertices"]).select("uc_id", F.round("area_geo", 6).alias("area_geo"))


def matrix_rollups(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = FRAMES["matriz"](tables(spark, sf_dir), frozenset({"hijas", "terreno", "construcciones"}))
    areas = ("suma_coeficiente", "suma_area_coeficiente", "area_terreno", "area_construcciones", "terreno_hijas", "construido_hijas")
    return df.select(
        "predio_id", "numero_predial_nacional", "n_hijas", "n_unidades_ph", *[F.round(c, 6).alias(c) for c in areas], "max_torre"
    )


def _new_folder(spark: SparkSession, name: str) -> str:
    """A new folder on the storage that the session shares; a local master may do without such a setting."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="linderos-")
    return f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _registry_file(spark: SparkSession, sf_dir: str) -> R1List:
    """The parcel numbers as CSV files on shared storage, read back by the loader: a byte-order mark, quoted fields, line
    breaks in a field, blanks around and instead of numbers, and repeats.  Each task writes a file with its own header."""
    path = _new_folder(spark, "registro")
    number = F.col("numero_predial_nacional")
    lines = tables(spark, sf_dir)["predio"].select(
        F.lit('linea 1\n"linea" 2').alias("obs"), F.concat(F.lit("  "), F.coalesce(number, F.lit("")), F.lit("\t")).alias("Numero_Predial"))
    lines.write.csv(path, header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    head = spark.createDataFrame([("\ufeffobs,Numero_Predial",), ('x,"A\nB, ""C"""',), ("x,   ",)], "value string").coalesce(1)
    head.write.mode("append").text(path)
    return read_r1_csv(spark, path)


def load_r1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registry numbers of a CSV file."""
    return _registry_file(spark, sf_dir).numbers


def r1_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows and distinct numbers of a CSV file."""
    return _registry_file(spark, sf_dir).rows.agg(F.count(F.lit(1)).alias("filas"), F.countDistinct("numero_predial").alias("distintos"))


SELECTED = {"categorias": ["registral", "coherencia_geografica"], "severidades": ["error"]}


def selected_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run over two categories and one severity."""
    found, _ = violations(tables(spark, sf_dir), select_rules(**SELECTED), NO_TIME)
    return found.drop("fecha_validacion")


def category_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Violations per category."""
    return counts_by_category(spark, catalogue(), _counted(spark, sf_dir))


ZONE = 12
ROADLESS = Rule(
    id="X-BUENO", descripcion="via", categoria="usuario",
    sql="SELECT 'cca_predio', T_Id, numero_predial_nacional, 'sin via', via, NULL FROM cca_predio WHERE via = {via}", parametros={"via": 3},
)
BROKEN = Rule(
    id="X-ROTO", descripcion="roto", categoria="usuario",
    sql="SELECT 'cca_predio', T_Id, NULL, 'm', cast(concat('x', via) AS int), NULL FROM cca_predio",
)


def _extended(spark: SparkSession, sf_dir: str) -> Cadastre:
    """The sample with one more column and one more table."""
    given = tables(spark, sf_dir).given
    customers = spark.read.parquet(f"{sf_dir}/customer.parquet")
    streets = customers.select(F.col("c_custkey").alias("T_Id"), F.col("c_custkey").alias("predio"), F.col("c_nationkey").alias("zona"))
    return Cadastre(spark, given | {"cca_predio": given["cca_predio"].withColumn("via", F.expr("T_Id % 7")), "cca_direccion": streets})


def user_rule_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user rule in SQL over a table that is not of the schema, with a parameter."""
    rule = Rule(
        id="X-SQL", descripcion="zona", categoria="usuario", parametros={"tope": ZONE},
        sql="SELECT 'cca_direccion', d.T_Id, p.numero_predial_nacional, 'grande', d.zona, {tope} "
            "FROM cca_direccion d JOIN cca_predio p ON d.predio = p.T_Id WHERE d.zona > {tope}",
    )
    return rule_findings(_extended(spark, sf_dir), rule).select(*FINDING)


def user_rule_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user rule over a column that is not of the schema."""
    return rule_findings(_extended(spark, sf_dir), ROADLESS).select(*FINDING)


def isolated_failure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of a run in which one user rule fails on its values: -1 for that rule, the others counted."""
    (built_in,) = [rule for rule in catalogue() if rule.id == "R-14"]
    summary = run_rules(_extended(spark, sf_dir), rules=[BROKEN, built_in, ROADLESS])
    return spark.createDataFrame([(rule_id, n) for rule_id, _, _, n in summary.por_regla], "regla_id string, n long")


def sink_rerun(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Violations kept after a run and a second one, of one category and severity, that finds nothing any more."""
    path = _new_folder(spark, "violaciones")
    whole = tables(spark, sf_dir)
    run_rules(whole, categorias=["duplicados", "registral"], output=path)
    clean = Cadastre(spark, whole.given | {"cca_predio": whole.given["cca_predio"].filter("folio_matricula is null")})
    run_rules(clean, categorias=["duplicados"], severidades=["advertencia"], output=path)
    return read_violations(spark, path).groupBy("categoria", "severidad").agg(F.count(F.lit(1)).alias("n"))


CUT_CATEGORIES, CUT_FRAME = ["duplicados", "registral", "novedades"], "novedad_numero"


def partial_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Violations per rule after a run of which one frame is killed, and after that run is resumed."""
    path, whole = _new_folder(spark, "violaciones"), tables(spark, sf_dir)

    def kill(run: str, frame: str) -> None:
        if frame == CUT_FRAME:
            cancel_frame(spark, run, frame)

    cut = run_rules(whole, categorias=CUT_CATEGORIES, output=path, on_frame=kill)
    run_rules(whole, categorias=CUT_CATEGORIES, output=path, resume=cut.corrida)
    states = [(1, "cortada"), (2, "retomada")]
    counted = [counts_by_rule(read_violations(spark, path, version=v)).select(F.lit(name).alias("fase"), "regla_id", "n") for v, name in states]
    return counted[0].unionByName(counted[1])


def sink_concurrent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Violations kept, step by step, by two runs that start together: the later commit is refused, then rebased; then the
    table is compacted in place and replaced parts are removed (their number is the last row)."""
    path, whole = _new_folder(spark, "violaciones"), tables(spark, sf_dir)
    clean = Cadastre(spark, whole.given | {"cca_predio": whole.given["cca_predio"].filter("folio_matricula is null")})
    steps: list[tuple[str, str | None, str | None, int]] = []

    def look(step: str) -> None:
        kept = read_violations(spark, path).groupBy("categoria", "severidad").agg(F.count(F.lit(1)).alias("n")).collect()
        steps.extend((step, r["categoria"], r["severidad"], r["n"]) for r in kept)

    def wrote(writing, given: Cadastre, rules) -> list[tuple[str, str, str]]:
        write_part(spark, writing, violations(given, rules, writing.when)[0], [rule.id for rule in rules])
        return [(rule.id, rule.categoria, rule.severidad) for rule in rules]

    one, two = begin(spark, path), begin(spark, path)
    covered = wrote(two, whole, select_rules(["duplicados"]))
    commit(spark, two, covered)
    look("segunda")
    covered = wrote(one, clean, select_rules(["duplicados", "registral"]))
    try:
        commit(spark, one, covered)
    except ConcurrentWrite:
        steps.append(("rechazada", None, None, 1))
    look("rechazada")
    commit(spark, rebased(spark, one), covered)
    look("primera")
    compact(spark, path)
    steps.append(("retiradas", None, None, len(vacuum(spark, path))))
    look("compacta")
    return spark.createDataFrame(steps, "paso string, categoria string, severidad string, n long")


def registry_lifecycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Views of the tables and the registry list seen by a user rule, and after that run and a failing one: none are left."""
    whole = tables(spark, sf_dir)
    registry = R1List(whole["r1"].select(F.col("r1_numero").alias("numero_predial")), whole["r1"].select(F.col("r1_numero").alias("numero_predial")))
    bare = whole.with_r1(None)
    listed = Rule(
        id="X-LISTA", descripcion="lista", categoria="usuario",
        sql="SELECT '_r1_predios', NULL, numero_predial, 'm', NULL, NULL FROM _r1_predios WHERE numero_predial < '255060000001'")
    seen = run_rules(bare, rules=[listed], r1=registry)
    rows = [("durante", seen.por_regla[0][3])]
    names = ("_r1_predios", "cca_predio")
    rows.append(("despues", sum(spark.catalog.tableExists(name) for name in names)))
    run_rules(bare, rules=[replace(listed, sql=BROKEN.sql.replace("via", "numero_predial").replace("cca_predio", "_r1_predios"))], r1=registry)
    rows.append(("tras_fallo", sum(spark.catalog.tableExists(name) for name in names)))
    rows.append(("sin_lista", run_rules(bare, rules=[listed]).por_regla[0][3]))
    return spark.createDataFrame(rows, "momento string, n long")


QUOTED = "Lote de O'Higgins {norte} \\ \"1\""


def user_rule_marker(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user rule with braces in its text, whose parameters are bound as typed values: a text with quotes, and a number."""
    rule = Rule(
        id="X-MARCA", descripcion="marca", categoria="usuario", parametros={"texto": QUOTED, "tope": ZONE},
        sql="SELECT 'cca_direccion', T_Id, regexp_extract(cast(predio as string), '^([0-9]{1,2})', 1), :texto, zona, :tope + 1 "
            "FROM cca_direccion WHERE zona > :tope",
    )
    return rule_findings(_extended(spark, sf_dir), rule).select(*FINDING)


def text_queries() -> tuple[dict[str, Callable[[SparkSession, str], DataFrame]], dict[str, str]]:
    """Queries and SQL of the training-text operators, where that subpackage is installed."""
    try:
        import corpus_pipeline
        from linderos.llm.queries import ORACLES, QUERIES
    except ImportError:
        return {}, {}
    sql = {"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {}
    return QUERIES | {"pipeline": corpus_pipeline.run}, ORACLES | sql


def entry(spark: SparkSession) -> DataFrame:
    """Flagship: violations per rule over the whole catalogue."""
    return by_rule(spark, SMOKE)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {key_of(rule.id): one_rule(rule) for rule in catalogue()}
    found |= {
        "all_violations": all_violations,
        "summary_by_rule": by_rule,
        "summary_by_severity": by_severity,
        "polygon_area": polygon_area,
        "matrix_rollups": matrix_rollups,
        "load_r1": load_r1,
        "r1_counts": r1_counts,
        "selected_rules": selected_rules,
        "category_counts": category_counts,
        "user_rule_sql": user_rule_sql,
        "user_rule_column": user_rule_column,
        "isolated_failure": isolated_failure,
        "sink_rerun": sink_rerun,
        "partial_run": partial_run,
        "sink_concurrent": sink_concurrent,
        "registry_lifecycle": registry_lifecycle,
        "user_rule_marker": user_rule_marker,
    }
    return found | text_queries()[0]


def oracle_sql() -> dict[str, str]:
    found = {key_of(rule.id): rules_sql.rule_sql(rule.id) for rule in catalogue()}
    found |= {
        "all_violations": rules_sql.violations_sql(),
        "summary_by_rule": rules_sql.summary_by_rule_sql(),
        "summary_by_severity": rules_sql.summary_by_severity_sql(),
        "polygon_area": rules_sql.polygon_area_sql(),
        "matrix_rollups": rules_sql.matrix_rollups_sql(),
        "load_r1": rules_sql.load_r1_sql(),
        "r1_counts": rules_sql.r1_counts_sql(),
        "selected_rules": rules_sql.selection_sql([rule.id for rule in select_rules(**SELECTED)]),
        "category_counts": rules_sql.category_counts_sql(),
        "user_rule_sql": rules_sql.user_rule_sql(ZONE),
        "user_rule_column": rules_sql.user_rule_column_sql(),
        "isolated_failure": rules_sql.isolated_failure_sql(),
        "sink_rerun": rules_sql.sink_rerun_sql(),
        "partial_run": rules_sql.partial_run_sql(CUT_CATEGORIES, ["RN-23", "RN-24-A", "RN-25"]),
        "sink_concurrent": rules_sql.sink_concurrent_sql(),
        "registry_lifecycle": rules_sql.registry_lifecycle_sql(),
        "user_rule_marker": rules_sql.user_rule_marker_sql(QUOTED, ZONE),
    }
    return found | text_queries()[1]
