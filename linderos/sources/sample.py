"""Cadastral tables projected from the generic star-schema sample tables.

The sample parquet files (orders, lineitem, customer, ...) hold no land-registry
columns, so this module derives the ten cadastral tables, the registry list and
the polygon vertices from them with plain column expressions.  The SQL is
portable: Spark runs it lazily over the parquet scans, and the same text heads
the DuckDB cross-check queries.  Every output row comes from an input row; the
arithmetic on keys only varies the values so each rule meets violating, clean
and NULL cells.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

SAMPLE_INPUTS = ("orders", "lineitem", "customer", "supplier", "nation", "events")

# A number shared by many parcels, as an operator's placeholder would be.
PLACEHOLDER_NP = "255060000000000010001000000000"

LETTERS = "translate(CAST({n} AS STRING), '0123456789', 'abcdefghij')"


def _hash(key: str) -> str:
    return f"(({key}) * 7919 + 13) % 1009"


def _condition(m: str, g: str, h: str) -> str:
    return f"""CASE {m} WHEN 0 THEN '0' WHEN 1 THEN '1' WHEN 2 THEN '2' WHEN 3 THEN '2'
        WHEN 4 THEN '3' WHEN 5 THEN '4' WHEN 6 THEN '4'
        WHEN 7 THEN CASE WHEN {g} % 2 = 0 THEN '5' ELSE '6' END
        WHEN 8 THEN CASE WHEN {g} % 2 = 0 THEN '7' ELSE '8' END
        WHEN 9 THEN '9' WHEN 10 THEN '10'
        ELSE CASE WHEN {h} % 5 = 0 THEN NULL ELSE '0' END END"""


def _number(p: str = "") -> str:
    """Thirty-character parcel number from the columns <p>k, <p>g, <p>m, <p>h."""
    k, g, m, h = f"{p}k", f"{p}g", f"{p}m", f"{p}h"
    suffix = f"""CASE WHEN {h} % 17 = 0 THEN '123456789'
        WHEN {m} = 1 THEN '900000000'
        WHEN {m} IN (2, 3) THEN '901' || lpad(CAST(1 + {k} % 3 AS STRING), 2, '0') || lpad(CAST({m} AS STRING), 4, '0')
        WHEN {m} = 4 THEN '800000000'
        WHEN {m} IN (5, 6) THEN '80000' || lpad(CAST({m} AS STRING), 4, '0')
        WHEN {m} = 7 AND {g} % 2 = 1 THEN '700000000'
        WHEN {m} = 8 THEN CASE WHEN {g} % 2 = 0 THEN '700000000' ELSE '400000000' END
        WHEN {m} = 9 THEN '200000000'
        WHEN {m} = 10 THEN '300000000'
        ELSE '000000000' END"""
    whole = f"""CASE WHEN {h} % 53 = 0 THEN '11001' ELSE '25506' END
        || lpad(CAST({g} AS STRING), 8, '0')
        || CASE WHEN {h} % 23 = 0 THEN '0000' ELSE lpad(CAST({g} % 9000 + 1 AS STRING), 4, '0') END
        || CASE WHEN {h} % 29 = 0 THEN '0000' ELSE lpad(CAST({m} + 1 AS STRING), 4, '0') END
        || {suffix}"""
    return f"""CASE WHEN {h} % 47 = 0 THEN NULL
        WHEN {h} % 41 = 0 THEN '{PLACEHOLDER_NP}'
        ELSE substr({whole}, 1, CASE WHEN {h} % 43 = 0 THEN 25 ELSE 30 END) END"""


def _key_columns(key: str, p: str = "") -> str:
    return (
        f"{key} AS {p}k, CAST(floor({key} / 12) AS BIGINT) AS {p}g, {key} % 12 AS {p}m, {_hash(key)} AS {p}h"
    )


_ORDER_BASE = f"""
    SELECT {_key_columns('o_orderkey')},
           o_custkey AS cust,
           o_totalprice AS price,
           o_orderpriority AS prio,
           CAST(CAST(o_orderdate AS DATE) AS STRING) AS dia
    FROM {{orders}}"""

# (order key, line number) repeats in the sample, so repeated lines are numbered; each is a unit of its own.
_LINE_BASE = f"""
    SELECT k, ln, id, m, {_hash('id')} AS h, part, qty, area
    FROM (SELECT l_orderkey AS k,
                 l_linenumber AS ln,
                 (l_orderkey * 10 + l_linenumber) * 100
                     + row_number() OVER (PARTITION BY l_orderkey, l_linenumber
                                          ORDER BY l_partkey, l_suppkey, l_quantity, l_extendedprice) - 1 AS id,
                 l_orderkey % 12 AS m,
                 l_partkey AS part,
                 l_quantity AS qty,
                 CAST(floor(l_extendedprice / 10) AS DOUBLE) / 100.0 AS area
          FROM {{lineitem}}) numbered"""

# The same rows for Spark: lines are numbered before anything is computed from them.  Spark would compute it below the window,
# so every table made of lines would shuffle columns of its own; as it is, tables of one plan share one shuffle of the lines.
_LINE_BASE_SPARK = f"""
    SELECT k, ln, id, m, {_hash('id')} AS h, part, qty, area
    FROM (SELECT l_orderkey AS k,
                 l_linenumber AS ln,
                 (l_orderkey * 10 + l_linenumber) * 100 + n - 1 AS id,
                 l_orderkey % 12 AS m,
                 l_partkey AS part,
                 l_quantity AS qty,
                 CAST(floor(l_extendedprice / 10) AS DOUBLE) / 100.0 AS area
          FROM (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice,
                       row_number() OVER (PARTITION BY l_orderkey, l_linenumber
                                          ORDER BY l_partkey, l_suppkey, l_quantity, l_extendedprice) AS n
                FROM {{lineitem}}) lines) numbered"""

_UNIT = "m IN (2, 3, 5, 6)"
_MATRIX = "m IN (1, 4)"
_BUILT = f"CASE WHEN {_UNIT} THEN CASE WHEN h % 9 = 0 THEN area ELSE 0.0 END WHEN {_MATRIX} THEN 60.0 " \
         "WHEN h % 16 = 0 THEN NULL WHEN h % 16 = 1 THEN 0.0 ELSE area END"
_PRIVATE = f"CASE WHEN {_UNIT} THEN CASE WHEN h % 14 = 0 THEN NULL WHEN h % 14 = 1 THEN 0.0 ELSE area END " \
           "WHEN h % 18 = 0 THEN area ELSE CAST(NULL AS DOUBLE) END"

PREDIO = f"""
SELECT k AS T_Id,
       {_number()} AS numero_predial_nacional,
       {_condition('m', 'g', 'h')} AS condicion_predio,
       CASE WHEN h % 3 = 0 THEN NULL WHEN h % 59 = 0 THEN '25001' WHEN h % 61 = 0 THEN '11506' ELSE '25506' END AS departamento_municipio,
       CASE WHEN {_UNIT} AND h % 13 = 0 THEN NULL
            WHEN {_UNIT} AND h % 61 = 0 THEN '   '
            WHEN {_UNIT} AND h % 67 = 0 THEN '255069999999999999999999999999'
            WHEN padre IS NOT NULL THEN {_number('p')} ELSE NULL END AS numero_predial_matriz,
       CASE WHEN h % 5 = 0 THEN NULL WHEN h % 71 = 0 THEN '  ' WHEN h % 73 = 0 THEN '50N-0'
            WHEN h % 6 = 1 THEN '50N-' || CAST(cust AS STRING) ELSE '50N-9' || CAST(k AS STRING) END AS folio_matricula,
       CASE WHEN h % 4 = 0 THEN NULL WHEN h % 79 = 0 THEN ' ' ELSE '50N' END AS codigo_orip,
       CASE WHEN h % 9 = 0 THEN NULL WHEN h % 9 = 1 THEN 0.0 ELSE price / 100.0 END AS area_registral_m2,
       CASE (k * 31 + 7) % 12 WHEN 0 THEN '9' WHEN 1 THEN '9' WHEN 2 THEN '5' WHEN 3 THEN '10' WHEN 4 THEN '7'
            WHEN 5 THEN '16' WHEN 6 THEN '19' WHEN 7 THEN '24' WHEN 8 THEN '23' WHEN 9 THEN '18' WHEN 10 THEN '20'
            ELSE NULL END AS destinacion_economica,
       CASE WHEN {_UNIT} THEN CASE WHEN h % 10 = 0 THEN 0.25 WHEN h % 10 = 1 THEN NULL ELSE 0.5 END
            ELSE CAST(NULL AS DOUBLE) END AS coeficiente_copropiedad,
       CASE WHEN {_UNIT} THEN (100.0 + (g % 50) * 20.0) / 2.0 + CASE WHEN h % 8 = 0 THEN 31.25 ELSE 0.0 END
            ELSE CAST(NULL AS DOUBLE) END AS area_coeficiente,
       CASE WHEN {_MATRIX} THEN CASE WHEN h % 12 = 0 THEN NULL WHEN h % 12 = 1 THEN 77.5
                 WHEN m = 1 THEN 100.0 + (g % 50) * 20.0 ELSE 200.0 + (g % 50) * 20.0 END
            WHEN h % 24 = 0 THEN 12.5 ELSE CAST(NULL AS DOUBLE) END AS area_total_terreno,
       CASE WHEN m = 1 THEN CASE WHEN h % 7 = 0 THEN 5.25 WHEN h % 7 = 1 THEN NULL ELSE 0.0 END
            WHEN m = 4 THEN CASE WHEN h % 7 = 0 THEN NULL ELSE 100.0 END
            WHEN h % 25 = 0 THEN 1.5 ELSE CAST(NULL AS DOUBLE) END AS area_total_terreno_privada,
       CASE WHEN {_MATRIX} THEN CASE WHEN h % 15 = 0 THEN NULL ELSE 180.0 END
            WHEN h % 26 = 0 THEN 1234567.891 ELSE CAST(NULL AS DOUBLE) END AS area_total_construida,
       CASE WHEN {_MATRIX} THEN CASE WHEN h % 6 = 0 THEN 45.5 ELSE 0.0 END
            WHEN h % 27 = 0 THEN 3.0 ELSE CAST(NULL AS DOUBLE) END AS area_total_construida_privada,
       CASE WHEN {_MATRIX} THEN CASE WHEN h % 20 = 0 THEN NULL ELSE 180.0 END
            WHEN h % 28 = 0 THEN 4.0 ELSE CAST(NULL AS DOUBLE) END AS area_total_construida_comun,
       CAST(CASE WHEN m = 1 THEN CASE WHEN h % 14 = 0 THEN NULL WHEN h % 6 = 0 THEN 2 ELSE 3 END
            WHEN m = 4 THEN CASE WHEN h % 6 = 0 THEN 1 WHEN h % 6 = 1 THEN NULL ELSE 0 END
            WHEN h % 30 = 0 THEN 1 ELSE NULL END AS INT) AS numero_torres,
       CAST(CASE WHEN {_MATRIX} THEN CASE WHEN h % 14 = 1 THEN NULL ELSE 2 END
            WHEN h % 32 = 0 THEN 5 ELSE NULL END AS INT) AS total_unidades_privadas,
       CASE WHEN h % 21 = 0 THEN NULL WHEN m = 10 AND h % 4 <> 0 THEN '2'
            ELSE CASE (k * 17 + 3) % 7 WHEN 0 THEN '0' WHEN 1 THEN '1' WHEN 2 THEN '2' WHEN 3 THEN '3' ELSE '4' END
            END AS tipo_predio,
       CASE WHEN h % 10 = 3 THEN NULL ELSE dia END AS fecha_visita_predio
FROM (SELECT *, {_key_columns('padre', 'p')} FROM (SELECT *, CASE WHEN {_UNIT} AND h % 11 = 0 THEN k - m WHEN m IN (2, 3) THEN k - m + 1 WHEN m IN (5, 6) THEN k - m + 4
                     WHEN m = 7 AND h % 11 = 0 THEN k - m + 1 ELSE NULL END AS padre
      FROM ({_ORDER_BASE}) base) parents) parcels"""

TERRENO = f"""
SELECT k * 10 + 1 AS T_Id,
       CASE WHEN h % 83 = 0 OR prio = '5-LOW' THEN NULL WHEN h % 89 = 0 THEN k + 1000000000000 ELSE k END AS predio,
       CASE WHEN h % 97 = 0 THEN 1.23456 WHEN h % 101 = 0 THEN NULL WHEN {_MATRIX} THEN 100.0 + (g % 50) * 20.0
            WHEN {_UNIT} THEN 50.0 ELSE CAST(floor(price) AS DOUBLE) / 1000.0 END AS AREA
FROM ({_ORDER_BASE}) first_polygon
UNION ALL
SELECT k * 10 + 2, k, CASE WHEN h % 5 = 0 THEN 0.75 ELSE 1.5 + h / 8.0 END
FROM ({_ORDER_BASE}) second_polygon WHERE prio = '1-URGENT'"""

UNIDAD = f"""
SELECT id AS T_Id,
       CASE WHEN h % 83 = 0 THEN NULL WHEN h % 89 = 0 THEN k + 1000000000000 ELSE k END AS predio,
       CASE WHEN ln = 3 THEN (k * 10 + 2) * 100 ELSE id END AS caracteristica,
       CAST(CASE WHEN h % 31 = 0 THEN NULL ELSE CAST(qty AS INT) % 12 - 1 END AS INT) AS planta_ubicacion
FROM ({_LINE_BASE}) base"""

CARACTERISTICA = f"""
SELECT id AS T_Id,
       CASE WHEN h % 37 = 0 THEN NULL ELSE substr('ABCDEFG', CAST(ln AS INT), 1) END AS identificador,
       CASE WHEN h % 41 = 0 THEN NULL ELSE CAST(part % 5 AS STRING) END AS tipo_construccion,
       CASE WHEN h % 43 = 0 THEN NULL WHEN h % 10 = 0 THEN CAST(part % 102 AS STRING)
            WHEN part % 5 = 0 THEN CAST(part % 15 AS STRING)
            WHEN part % 5 = 1 THEN CAST(15 + part % 24 AS STRING)
            WHEN part % 5 = 2 THEN CAST(39 + part % 5 AS STRING)
            WHEN part % 5 = 3 THEN CAST(44 + part % 23 AS STRING)
            ELSE CAST(67 + part % 35 AS STRING) END AS uso_unidad_construccion,
       {_BUILT} AS area_construida,
       {_PRIVATE} AS area_privada_construida,
       CAST(CASE WHEN h % 19 = 0 THEN NULL WHEN h % 19 = 1 THEN 0 WHEN h % 19 = 2 THEN -1 ELSE 1 + part % 6 END AS INT) AS total_plantas
FROM ({_LINE_BASE}) base"""


def _right(j: int, where: str, parcel: str = "k") -> str:
    year = "CAST(substr(dia, 1, 4) AS INT)"
    return f"""
SELECT k * 10 + {j} AS T_Id,
       {parcel} AS predio,
       CASE WHEN h % 35 = {j} THEN NULL ELSE CAST((k * 13 + {j}) % 3 AS STRING) END AS tipo_derecho,
       CASE WHEN h % 26 = 0 THEN NULL WHEN h % 26 = 1 THEN ' ' WHEN h % 26 = 2 THEN dia
            WHEN h % 8 = 0 THEN CAST({year} + 1 AS STRING) || substr(dia, 5, 6)
            ELSE CAST({year} - 1 AS STRING) || substr(dia, 5, 6) END AS fecha_inicio_derecho,
       CASE WHEN h % 6 = {j} OR h % 33 = 0 THEN NULL WHEN h % 4 = 1 THEN 0 ELSE cust END AS interesado,
       CASE WHEN h % 6 = {j} OR h % 34 = 0 THEN cust % 25 ELSE NULL END AS agrupacion,
       CASE WHEN h % 11 = 0 THEN NULL ELSE (k * 3) % 120 END AS fuente,
       CASE h % 4 WHEN 0 THEN NULL WHEN 1 THEN '  ' ELSE 'motivo ' || CAST(h AS STRING) END AS observacion
FROM ({_ORDER_BASE}) base_{j} WHERE {where}"""


DERECHO = (
    _right(1, "TRUE", "CASE WHEN prio = '4-NOT SPECIFIED' THEN NULL ELSE k END")
    + "\nUNION ALL" + _right(2, "prio IN ('1-URGENT', '2-HIGH')")
    + "\nUNION ALL" + _right(3, "prio = '2-HIGH'")
)

INTERESADO = f"""
SELECT k AS T_Id,
       tipo AS tipo_interesado,
       CASE WHEN h % 15 = 0 THEN NULL WHEN tipo = '1' THEN CASE WHEN h % 5 < 3 THEN '2' ELSE CAST(h % 8 AS STRING) END
            ELSE CAST(h % 9 AS STRING) END AS tipo_documento,
       CASE WHEN h % 28 = 0 THEN NULL WHEN h % 28 = 1 THEN '  ' WHEN h % 28 = 2 THEN ' 0 ' WHEN h % 28 = 3 THEN '900111'
            WHEN h % 5 = 0 THEN '800' || CAST(k AS STRING) || '-' || CAST(k % 10 AS STRING)
            WHEN h % 9 = 0 THEN '52' || CAST(CAST(floor(k / 2) AS BIGINT) AS STRING)
            ELSE '79' || CAST(k AS STRING) END AS numero_documento,
       CASE WHEN tipo = '1' AND h % 10 <> 0 THEN NULL WHEN h % 39 = 0 THEN NULL WHEN h % 39 = 1 THEN '   '
            WHEN h % 39 = 2 THEN 'Suc. de ' || trio WHEN h % 39 = 3 THEN 'ana suc ' || trio WHEN h % 39 = 4 THEN 'SUCESION ' || trio
            WHEN h % 11 = 0 THEN c_name WHEN h % 11 = 1 THEN 'Ana, ' || trio WHEN h % 11 = 2 THEN 'José ' || trio
            WHEN h % 11 = 3 THEN 'JOSÉ ' || trio WHEN h % 11 = 4 THEN ' ANA ' || trio || ' ' WHEN h % 11 = 5 THEN 'MUNICIPIO DE ' || trio
            ELSE 'Ana ' || trio END AS nombre_interesado,
       CASE WHEN tipo = '1' THEN CASE WHEN h % 38 = 0 THEN NULL WHEN h % 7 = 0 THEN 'NACION ' || trio WHEN h % 7 = 1 THEN 'nacion colombiana'
                 WHEN h % 7 = 2 THEN 'Nación ' || trio WHEN h % 7 = 3 THEN 'Agencia Nacional de Tierras' ELSE 'Empresa ' || trio || ' S.A.' END
            WHEN h % 12 = 0 OR h % 39 = 0 THEN 'Empresa ' || trio WHEN h % 12 = 1 THEN ' ' ELSE NULL END AS razon_social,
       CASE h % 3 WHEN 0 THEN 'M' WHEN 1 THEN 'F' ELSE NULL END AS sexo,
       CASE WHEN h % 8 = 7 THEN NULL ELSE CAST(h % 8 AS STRING) END AS grupo_etnico
FROM (SELECT c_custkey AS k, c_name, {_hash('c_custkey')} AS h,
             {LETTERS.format(n='CAST(floor(c_custkey / 3) AS BIGINT)')} AS trio,
             CASE WHEN c_custkey % 50 = 49 THEN NULL WHEN c_nationkey % 5 = 0 THEN '0' WHEN c_nationkey % 5 = 1 THEN '1'
                  WHEN c_custkey % 3 = 0 THEN '1' ELSE '0' END AS tipo
      FROM {{customer}}) base"""

AGRUPACION = """
SELECT CAST(n_nationkey AS BIGINT) AS T_Id,
       CASE WHEN n_nationkey % 9 = 8 THEN NULL ELSE CAST(n_nationkey % 4 AS STRING) END AS tipo_agrupacion,
       CASE WHEN n_nationkey % 7 = 6 THEN NULL ELSE n_name END AS nombre_agrupacion,
       CAST(CASE n_nationkey % 6 WHEN 0 THEN 0.0 WHEN 1 THEN 1.0 WHEN 2 THEN 0.5 WHEN 3 THEN 1.0005 WHEN 4 THEN NULL ELSE 0.333 END AS DOUBLE) AS porcentaje_participacion
FROM {nation}"""

MIEMBRO = """
SELECT CAST(c_nationkey AS BIGINT) AS agrupacion, c_custkey AS interesado
FROM {customer}"""

FUENTE = f"""
SELECT k AS T_Id,
       CASE WHEN h % 11 = 5 THEN NULL ELSE CAST(h % 5 AS STRING) END AS tipo_fuente,
       CASE WHEN h % 8 = 0 THEN NULL WHEN h % 8 = 1 THEN ' ' ELSE s_name END AS nombre_fuente,
       CASE h % 10 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN 'Notaria 3 de Bogota' WHEN 3 THEN 'NOTARÍA 5' WHEN 4 THEN 'notaria unica'
            WHEN 5 THEN 'Juzgado 2 Civil' WHEN 6 THEN 'tribunal superior' WHEN 7 THEN 'Corte Suprema' ELSE 'Alcaldia' END AS ente_emisor,
       CASE WHEN h % 12 = 0 THEN NULL WHEN h % 12 = 1 THEN '  '
            ELSE CAST(1994 + h % 8 AS STRING) || '-0' || CAST(1 + h % 9 AS STRING) || '-15' END AS fecha_fuente
FROM (SELECT s_suppkey AS k, s_name, {_hash('s_suppkey')} AS h FROM {{supplier}}) base"""

NOVEDAD = f"""
SELECT e AS T_Id,
       CASE WHEN t % 103 = 0 THEN NULL WHEN t % 107 = 0 THEN fk + 1000000000000 ELSE fk END AS cca_predio_novedad_numero_predial,
       CASE WHEN t % 109 = 0 THEN NULL WHEN t % 8 = 0 THEN '0' WHEN t % 8 = 1 THEN '6' WHEN t % 8 = 2 THEN '2' WHEN t % 8 = 3 THEN '5'
            WHEN t % 16 = 4 THEN '13' WHEN t % 16 = 12 THEN '4' ELSE CAST(t % 31 AS STRING) END AS tipo_novedad,
       CASE WHEN t % 13 = 0 THEN NULL
            ELSE substr({_number()}, 1, CASE WHEN t % 19 = 0 THEN 20 ELSE 30 END) END AS numero_predial
FROM (SELECT e, t, fk, {_key_columns('otro')} FROM (
      SELECT e, t, q * 4 + q % 4 AS fk, q * 4 + q % 4 + CASE WHEN t % 5 = 0 THEN 12 ELSE 0 END AS otro
      FROM (SELECT event_id AS e, {_hash('event_id')} AS t, CAST(floor(event_id / 3) AS BIGINT) AS q FROM {{events}}) thirds) pairs) base"""

# The previous registry: parcels opened before 1998, and a number since retired for each later one and each owner.
REGISTRO1 = f"""
SELECT DISTINCT numero_predial FROM (
    SELECT CASE WHEN dia < '1998-01-01' THEN {_number()}
                ELSE '25506' || lpad(CAST(k AS STRING), 8, '8') || '00080008000000000' END AS numero_predial
    FROM ({_ORDER_BASE}) old
    UNION ALL
    SELECT '25506' || lpad(CAST(c_custkey AS STRING), 8, '9') || '00070007000000000' FROM {{customer}}
) registry WHERE numero_predial IS NOT NULL"""

# A rectangle per building unit, of no known unit for small quantities; some have a 1 x 1 hole, some are drawn too tall.
_CORNERS = [
    (0, 0, "x0", "y0"), (0, 1, "x0 + 10.0", "y0"), (0, 2, "x0 + 10.0", "y0 + alto"), (0, 3, "x0", "y0 + alto"),
]
_HOLE = [
    (1, 0, "x0 + 1.0", "y0 + 1.0"), (1, 5, "x0 + 1.0", "y0 + 2.0"), (1, 7, "x0 + 2.0", "y0 + 2.0"), (1, 9, "x0 + 2.0", "y0 + 1.0"),
]
# Coordinates are metres of a national grid: seven digits before the point, two after it.
_GRID_EAST, _GRID_NORTH = 4_880_312.37, 2_070_845.61
_VERTEX_BASE = f"""
    SELECT CASE WHEN qty > 2 THEN id ELSE -id END AS uc_id, h,
           CAST({_GRID_EAST} AS DOUBLE) + CAST(k % 1000 AS DOUBLE) AS x0, CAST({_GRID_NORTH} AS DOUBLE) + CAST(ln * 10 AS DOUBLE) AS y0,
           COALESCE(CASE WHEN {_UNIT} THEN {_PRIVATE} ELSE {_BUILT} END, 50.0) / 10.0
             + CASE WHEN h % 7 = 0 THEN 4.5 ELSE 0.07 END AS alto
    FROM ({_LINE_BASE}) lines"""


def _vertices(dialect: str) -> str:
    def row(ring, seq, x, y):
        fields = (("ring", ring), ("seq", seq), ("x", x), ("y", y))
        if dialect == "spark":
            return "named_struct(" + ", ".join(f"'{n}', {v}" for n, v in fields) + ")"
        return "{{" + ", ".join(f"'{n}': {v}" for n, v in fields) + "}}"

    if dialect == "spark":
        outer = "array(" + ", ".join(row(*c) for c in _CORNERS) + ")"
        both = "array(" + ", ".join(row(*c) for c in _CORNERS + _HOLE) + ")"
        spread = "explode"
    else:
        outer = "[" + ", ".join(row(*c) for c in _CORNERS) + "]"
        both = "[" + ", ".join(row(*c) for c in _CORNERS + _HOLE) + "]"
        spread = "unnest"
    return f"""
SELECT uc_id, v.ring AS ring, v.seq AS seq, v.x AS x, v.y AS y
FROM (SELECT uc_id, {spread}(CASE WHEN h % 9 = 0 THEN {both} ELSE {outer} END) AS v
      FROM ({_VERTEX_BASE}) shapes) corners"""


def sample_sql(dialect: str) -> dict[str, str]:
    """SQL per cadastral table; ``{orders}`` etc. stand for the input tables."""
    found = {
        "cca_predio": PREDIO,
        "cca_terreno": TERRENO,
        "cca_unidadconstruccion": UNIDAD,
        "cca_caracteristicaucons": CARACTERISTICA,
        "cca_derechocatastral": DERECHO,
        "cca_interesado": INTERESADO,
        "cca_agrupacioninteresados": AGRUPACION,
        "cca_interesado_agrupacion": MIEMBRO,
        "cca_fuenteadministrativa": FUENTE,
        "cca_estructuranovedadnumeropredial": NOVEDAD,
        "_r1_predios": REGISTRO1,
        "uc_vertices": _vertices(dialect),
    }
    return {name: text.replace(_LINE_BASE, _LINE_BASE_SPARK) for name, text in found.items()} if dialect == "spark" else found


def write_sample(spark: SparkSession, sf_dir: str, location: str) -> str:
    """Project the sample into Parquet tables that `load_tables` reads, for benchmarks and tests."""
    for name, df in sample_frames(spark, sf_dir).items():
        df.write.mode("overwrite").parquet(f"{location}/{name}")
    return location


def _set_apart(df: DataFrame, *names: str) -> DataFrame:
    """The same rows; the named columns are made once, by a generator, and never copied into what reads them.

    Catalyst pulls a projection's expressions into every filter and join condition above it.  For these long ones the
    classes generated for a stage would be too large to compile.
    """
    others = [c for c in df.columns if c not in names]
    return df.select(*others, F.inline(F.array(F.struct(*names)))).select(*df.columns)


def sample_frames(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The cadastral tables as lazy DataFrames over the sample parquet files."""
    inputs = {name: spark.read.parquet(f"{sf_dir}/{name}.parquet") for name in SAMPLE_INPUTS}
    frames = {name: spark.sql(text, **inputs) for name, text in sample_sql("spark").items()}
    frames["cca_predio"] = _set_apart(frames["cca_predio"], "numero_predial_nacional", "numero_predial_matriz")
    frames["_r1_predios"] = _set_apart(frames["_r1_predios"], "numero_predial")
    return frames


def sample_ctes() -> str:
    """The same tables as a DuckDB ``WITH`` prefix over the registered views."""
    names = {name: name for name in SAMPLE_INPUTS}
    parts = (f"{table} AS ({text.format(**names)})" for table, text in sample_sql("duckdb").items())
    return "WITH " + ",\n".join(parts)
