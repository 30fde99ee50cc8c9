"""Every rule on small generated tables: NULL and blank cells in every column, exact limits, dangling keys, repeats.

Values come from short lists, so that each rule meets violating, clean and NULL cases within a few dozen rows.  Areas
are exact in binary, and lie on, just inside and just outside the tolerances (2 m2, 5 % above 500 m2).
"""

import random

import duckdb
import pytest

from conftest import bag
from linderos.plans.run import violations
from linderos.rules import catalogue
from linderos.schema import TABLES
from linderos.sources.tables import load_tables
from oracle import rules_sql

ROWS = 40
AREAS = [None, 0.0, 0.75, 1.5, 2.0, 50.0, 98.0, 100.0, 102.0, 102.5, 500.0, 502.0, 504.0, 600.0, 630.0, 630.5, 570.0, 569.5]
SUFFIXES = ["000000000", "123456789", "900000000", "901010001", "902020002", "900000001", "800000000", "800000001", "599999999", "700000000"]
CODES = [None, *map(str, range(0, 11))]
DATES = [None, "", " ", "1995-06-15", "2001-01-01", "2001-01-02", "2010-12-31"]
NAMES = [None, "", "   ", "Ana", " ANA ", "José", "JOSÉ", "Suc. de Ana", "NACION uno", "Municipio dos", "Agencia Nacional de Tierras", "Ana 1", "Eva, x"]
DOCUMENTS = [None, "", " ", "0", " 0 ", "79", "80-1", "800-2", "900111"]
TEXTS = [None, "", "  ", "motivo"]


def numbers(rng):
    found = ["25506" + "0" * 8 + rng.choice(["0000", "0001"]) + rng.choice(["0000", "0007"]) + rng.choice(SUFFIXES) for _ in range(18)]
    return [*found, "11506" + found[0][5:], found[1][:29], found[2][:20], "", "   ", None]


def pool(rng, table, column, known):
    parcels = [None, *range(1, ROWS + 1), 10**9]
    ids = [None, *range(1, 13), 10**9]
    if column in ("numero_predial_nacional", "numero_predial_matriz", "numero_predial"):
        return known
    if column in ("predio", "cca_predio_novedad_numero_predial"):
        return parcels
    if column in ("caracteristica", "uc_id"):
        return [None, *range(1, ROWS + 1)] if column == "caracteristica" else [*range(1, ROWS + 1)]
    if column in ("interesado", "agrupacion", "fuente"):
        return ids
    return {
        "departamento_municipio": [None, "25506", "25001", "11506", "25"], "folio_matricula": [None, "", " ", "50N-0", "50N-1", "50N-2"],
        "codigo_orip": TEXTS, "destinacion_economica": [None, "5", "7", "9", "10", "16", "18", "19", "20", "23", "24"],
        "coeficiente_copropiedad": [None, 0.25, 0.5, 1.0], "tipo_predio": [None, "0", "1", "2", "3", "4"], "tipo_derecho": [None, "0", "1", "2"],
        "numero_torres": [None, 0, 1, 2], "total_unidades_privadas": [None, 0, 1, 2, 3], "planta_ubicacion": [None, -1, 0, 1, 5],
        "identificador": [None, "A", "B", "C"], "tipo_construccion": [None, "0", "1", "2", "3", "4"], "total_plantas": [None, -1, 0, 1, 3],
        "uso_unidad_construccion": [None, *map(str, (0, 5, 14, 15, 38, 39, 43, 44, 66, 67, 101))], "observacion": TEXTS,
        "tipo_interesado": [None, "0", "1"], "nombre_interesado": NAMES, "razon_social": NAMES, "numero_documento": DOCUMENTS,
        "sexo": [None, "M", "F"], "grupo_etnico": [None, "1", "6"], "tipo_agrupacion": [None, "0", "1", "2", "3"], "nombre_agrupacion": TEXTS,
        "porcentaje_participacion": [None, 0.0, 0.5, 1.0, 1.0005, 1.5], "tipo_fuente": [None, "0", "1", "2", "3"], "nombre_fuente": TEXTS,
        "ente_emisor": [None, "", "Notaria 3", "notaría unica", "Juzgado 2", "Tribunal", "Alcaldia"],
        "fecha_fuente": DATES, "fecha_visita_predio": DATES, "fecha_inicio_derecho": DATES, "tipo_novedad": [None, *map(str, (*range(0, 14), 20, 29, 30))],
        "condicion_predio": CODES, "tipo_documento": CODES,
    }.get(column, AREAS)


def rows(rng, table, known):
    if table == "uc_vertices":
        corners = [(0, 0), (1, 0), (1, 1), (0, 1)]
        return [(u, 0, 3 * n, float(x * 10), float(y * rng.choice([5, 10, 50]))) for u in range(1, ROWS, 2) for n, (x, y) in enumerate(corners)]
    if table == "_r1_predios":
        return [(n,) for n in known[:9]]
    fields = TABLES[table].names
    count = 12 if table in ("cca_interesado", "cca_agrupacioninteresados", "cca_fuenteadministrativa") else ROWS
    made = []
    for i in range(1, count + 1):
        made.append(tuple(i if f == "T_Id" else rng.choice(pool(rng, table, f, known)) for f in fields))
    return made


@pytest.fixture(scope="module", params=[1, 2, 3])
def generated(request, spark, tmp_path_factory):
    rng = random.Random(request.param)
    folder = str(tmp_path_factory.mktemp("generated"))
    known = numbers(rng)
    con = duckdb.connect()
    for table, schema in TABLES.items():
        spark.createDataFrame(rows(rng, table, known), schema).coalesce(1).write.parquet(f"{folder}/{table}")
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}/*.parquet'")
    # A list that comes ready-made is stripped, not blank, and distinct.
    con.execute(f"""CREATE OR REPLACE VIEW _r1_predios AS SELECT DISTINCT trim(numero_predial) AS numero_predial
        FROM '{folder}/_r1_predios/*.parquet' WHERE trim(numero_predial) <> ''""")
    return load_tables(spark, folder), con


_seen: dict[str, set[str]] = {"violated": set()}


def test_every_rule_against_sql(generated, monkeypatch):
    tables, con = generated
    monkeypatch.setattr(rules_sql, "sample_ctes", lambda: "WITH none_of_the_sample AS (SELECT 1)")
    found, failed = violations(tables, catalogue(), "")
    assert not failed
    columns = ["regla_id", "tabla", "t_id", "clave_negocio", "mensaje", "valor_actual", "valor_esperado"]
    expected = con.execute(f"SELECT {', '.join(columns)} FROM ({rules_sql.violations_sql()}) v").fetchall()
    got = found.select(*columns).collect()
    wrong = {r[0] for r in set(map(tuple, got)) ^ set(map(tuple, expected))}
    assert not wrong
    assert bag(got) == bag(expected)
    _seen["violated"] |= {r[0] for r in got}


def test_nearly_every_rule_was_violated():
    missing = {r.id for r in catalogue()} - _seen["violated"]
    assert len(missing) <= 8, missing
