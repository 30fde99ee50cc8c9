"""DuckDB cross-checks: the same results by other means.

Written for DuckDB with windows, QUALIFY, SEMI/ANTI joins and FILTER clauses,
apart from the Spark plans.  Only the message texts and the uses per construction type are shared; code sets and
thresholds are written down here again, so that a wrong one shows.
"""

from __future__ import annotations

from linderos.rules import catalogue
from linderos.sources.sample import sample_ctes
from linderos.texts import DOMINANT_TYPES, SUFFIXES, TEXTS, USE_DOMAINS

NP = "numero_predial_nacional"


class K:
    """Fixed values of the land-registry model."""

    TOLERANCE_SHARE, TOLERANCE_M2, TOLERANCE_THRESHOLD_M2 = 0.05, 2.0, 500.0
    NEEDS_TERRAIN = "0 1 3 4 6 8 9 10".split()
    NEEDS_BUILDING = "5 7 9 10 16 24".split()
    NEW_PARCEL, SPLIT, MERGE = "0 1".split(), "2 3".split(), "4 5".split()
    CANCELLATION = "6 7 8 9 10 11 12".split()
    NUMBER_CHANGE = "13 14 15 16 17 18 19 20 21 22 23 24 25 26 27 28 29".split()
    PUBLIC_BODIES = ("NACION", "MUNICIPIO", "AGENCIA NACIONAL DE TIERRAS")
    PH_USES = "0 5 7 8 9 12 14 16 18 22 25 28 31 36 38 40 42 55".split()


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def inset(column: str, values) -> str:
    return f"{column} IN ({', '.join(q(v) for v in values)})"


def blank(x: str) -> str:
    return f"coalesce(trim({x}), '') = ''"


def filled(x: str) -> str:
    return f"coalesce(trim({x}), '') <> ''"


def real(x: str) -> str:
    return f"regexp_replace(printf('%.15g', ({x})::DOUBLE), '^(-?[0-9]+)(e.*)?$', '\\1.0\\2')"


def rnd(x: str, n: int) -> str:
    return real(f"round(({x})::DOUBLE, {n})")


def txt(x: str) -> str:
    return f"({x})::VARCHAR"


def word(x: str) -> str:
    return f"ifnull({x}, 'NULL')"


def upper(x: str) -> str:
    return f"translate({x}, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ')"


def cut(x: str, at: int, n: int) -> str:
    return f"substr({x}, {at}, {n})"


def off(declared: str, expected: str) -> str:
    d, e = f"ifnull({declared}, 0.0)", f"ifnull({expected}, 0.0)"
    return f"abs({d} - {e}) > if({e} > {K.TOLERANCE_THRESHOLD_M2}, {K.TOLERANCE_SHARE} * {e}, {K.TOLERANCE_M2})"


def msg(rule_id: str, n: int = 0) -> str:
    return q(TEXTS[rule_id].mensajes[n])


SQL: dict[str, str] = {}


def add(rule_id: str, source: str, where: str, tabla: str, t_id: str, clave: str, actual: str,
        mensaje: str | None = None, esperado: str | None = None, tail: str = "") -> None:
    """One SELECT of the six finding columns; a second call adds a UNION ALL branch."""
    text = TEXTS[rule_id]
    body = (
        f"SELECT {q(tabla)} AS tabla, {t_id} AS t_id, {clave} AS clave_negocio, {mensaje or q(text.mensaje)} AS mensaje, "
        f"{actual} AS valor_actual, {esperado or q(text.esperado)} AS valor_esperado FROM {source} WHERE {where} {tail}"
    )
    SQL[rule_id] = f"{SQL[rule_id]} UNION ALL {body}" if rule_id in SQL else body


def parcel(rule_id: str, where: str, actual: str, mensaje=None, esperado=None, source="cca_predio", tid="T_Id", tail="") -> None:
    add(rule_id, source, where, "cca_predio", tid, NP, actual, mensaje, esperado, tail)


# Helper relations shared by several cross-checks.
VIEWS = f"""
area_uc AS (
    SELECT uc_id, sum(CASE WHEN ring = 0 THEN a ELSE -a END) AS area_geo FROM (
        SELECT uc_id, ring, abs(sum(x * ny - nx * y)) / 2 AS a FROM (
            SELECT uc_id, ring, x - first_value(x) OVER w AS x, y - first_value(y) OVER w AS y,
                   ifnull(lead(x) OVER w - first_value(x) OVER w, 0) AS nx,
                   ifnull(lead(y) OVER w - first_value(y) OVER w, 0) AS ny
            FROM uc_vertices WINDOW w AS (PARTITION BY uc_id, ring ORDER BY seq)
        ) GROUP BY uc_id, ring) GROUP BY uc_id),
uc AS (
    SELECT u.T_Id AS unidad_id, u.predio, c.*  FROM cca_unidadconstruccion u, cca_caracteristicaucons c WHERE u.caracteristica = c.T_Id),
puc AS (
    SELECT uc.*, p.T_Id AS pid, p.{NP}, p.condicion_predio, p.destinacion_economica, area_geo
    FROM uc SEMI JOIN cca_predio ON uc.predio = cca_predio.T_Id JOIN cca_predio p ON p.T_Id = uc.predio LEFT JOIN area_uc ON uc_id = unidad_id),
suelo AS (SELECT predio, count(*) AS n, sum(AREA) AS a FROM cca_terreno GROUP BY ALL),
techo AS (SELECT predio, sum(area_construida) AS a FROM uc GROUP BY ALL),
matriz AS (
    SELECT m.*, ifnull(s.a, 0) AS suelo_m, ifnull(t.a, 0) AS techo_m, ifnull(h.n, 0) AS n_h, ifnull(h.n_ph, 0) AS n_ph, h.coef, h.acoef,
           ifnull(h.suelo, 0) AS suelo_h, ifnull(h.techo, 0) AS techo_h, h.torre
    FROM cca_predio m
    LEFT JOIN suelo s ON s.predio = m.T_Id LEFT JOIN techo t ON t.predio = m.T_Id
    LEFT JOIN (
        SELECT numero_predial_matriz AS np_m, count(*) AS n, count(*) FILTER (condicion_predio IN ('2', '4')) AS n_ph,
               sum(coeficiente_copropiedad) FILTER (condicion_predio IN ('2', '4')) AS coef,
               sum(area_coeficiente) FILTER (condicion_predio IN ('2', '4')) AS acoef,
               sum(suelo.a) AS suelo, sum(techo.a) AS techo,
               max(CASE WHEN {NP} IS NOT NULL THEN ifnull(try_cast(regexp_extract(trim({cut(NP, 25, 2)}), '^[+-]?[0-9]+') AS INT), 0) END) AS torre
        FROM cca_predio k LEFT JOIN suelo ON suelo.predio = k.T_Id LEFT JOIN techo ON techo.predio = k.T_Id
        GROUP BY ALL) h ON h.np_m = m.{NP}
    WHERE m.condicion_predio IN ('1', '3')),
pd AS (SELECT p.*, d.T_Id AS did, d.* EXCLUDE (T_Id) FROM cca_derechocatastral d, cca_predio p WHERE d.predio = p.T_Id),
pdi AS (SELECT pd.*, i.* EXCLUDE (T_Id), ifnull(razon_social, nombre_interesado) AS quien FROM pd LEFT JOIN cca_interesado i ON i.T_Id = pd.interesado),
pdf AS (SELECT pd.*, f.* EXCLUDE (T_Id) FROM pd LEFT JOIN cca_fuenteadministrativa f ON f.T_Id = pd.fuente),
socio AS (
    SELECT g.agrupacion AS grupo, i.*, ifnull(i.razon_social, i.nombre_interesado) AS quien
    FROM cca_interesado_agrupacion g JOIN cca_interesado i ON i.T_Id = g.interesado),
pn AS (
    SELECT p.*, n.T_Id AS nid, n.tipo_novedad, n.numero_predial
    FROM cca_estructuranovedadnumeropredial n, cca_predio p WHERE n.cca_predio_novedad_numero_predial = p.T_Id),
nv AS (SELECT T_Id, cca_predio_novedad_numero_predial AS fk, tipo_novedad, numero_predial FROM cca_estructuranovedadnumeropredial)"""

# ------------------------------------------------------------------ parcel numbers
_CONDITIONS = {
    "R-01": "'0'", "R-02": "'10'", "R-03": "'8'", "R-04": "'6', '7'", "R-05": "'9'", "R-10": "'1'", "R-12": "'3'",
}
for _id, (_suffix, *_rest) in SUFFIXES.items():
    parcel(_id, f"condicion_predio IN ({_CONDITIONS[_id]}) AND {cut(NP, 22, 9)} <> '{_suffix}'", cut(NP, 22, 9))
parcel("R-08-A", f"length({NP}) <> 30", txt(f"length({NP})"))
add("R-08-B", "nv", "length(numero_predial) <> 30", "cca_estructuranovedadnumeropredial", "T_Id", "numero_predial",
    txt("length(numero_predial)"))
parcel("R-09", f"'0000' IN ({cut(NP, 14, 4)}, {cut(NP, 18, 4)})", f"concat_ws('/', {cut(NP, 14, 4)}, {cut(NP, 18, 4)})",
       f"if({cut(NP, 14, 8)} = '00000000', {msg('R-09', 0)}, if({cut(NP, 14, 4)} = '0000', {msg('R-09', 1)}, {msg('R-09', 2)}))")
parcel("R-11", f"condicion_predio = '2' AND ({cut(NP, 22, 1)} <> '9' OR {cut(NP, 23, 2)} = '00' OR {cut(NP, 25, 2)} = '00' OR {cut(NP, 27, 4)} = '0000')",
       cut(NP, 22, 9))
parcel("R-13", f"condicion_predio = '4' AND ({cut(NP, 22, 5)} <> '80000' OR {cut(NP, 27, 4)} = '0000')", cut(NP, 22, 9))
parcel("R-14", f"{cut(NP, 22, 1)} IN ('1', '5', '6')", cut(NP, 22, 1))
_dep, _mun = f"ifnull({cut('departamento_municipio', 1, 2)}, '25')", f"ifnull({cut('departamento_municipio', 3, 3)}, '506')"
parcel("R-15", f"{cut(NP, 1, 2)} <> {_dep}", cut(NP, 1, 2), esperado=_dep)
parcel("R-16", f"{cut(NP, 3, 3)} <> {_mun}", cut(NP, 3, 3), esperado=_mun)

# ------------------------------------------------------------------ duplicates, registry data
parcel("R-17", f"{NP} IS NOT NULL", NP, tail=f"QUALIFY count(*) OVER (PARTITION BY {NP}) > 1")
parcel("R-18", filled("folio_matricula"), "folio_matricula", tail="QUALIFY count(*) OVER (PARTITION BY folio_matricula) > 1")
_area = f"concat('orip=', codigo_orip, ' | matricula=', folio_matricula, ' | area=', {real('area_registral_m2')})"
parcel("R-24-A", f"area_registral_m2 > 0 AND {blank('codigo_orip')} AND {blank('folio_matricula')}", _area)
parcel("R-24-B", f"area_registral_m2 > 0 AND ({blank('codigo_orip')} OR {blank('folio_matricula')})", _area)

# ------------------------------------------------------------------ use, terrain
_conteo = "(SELECT p.*, count(u.T_Id) AS n FROM cca_predio p LEFT JOIN cca_unidadconstruccion u ON u.predio = p.T_Id GROUP BY ALL)"
parcel("R-21", "destinacion_economica = '19' AND n > 0", txt("n"), f"concat({msg('R-21', 0)}, n, {msg('R-21', 1)})", source=_conteo)
parcel("R-23", f"{inset('destinacion_economica', K.NEEDS_BUILDING)} AND n = 0", "'0'", source=_conteo)
_con_suelo = "(SELECT p.*, ifnull(n, 0) AS n FROM cca_predio p LEFT JOIN suelo ON predio = p.T_Id)"
_canc = f"(SELECT DISTINCT fk FROM nv WHERE {inset('tipo_novedad', K.CANCELLATION)})"
parcel("R-25-A", f"{inset('condicion_predio', K.NEEDS_TERRAIN)} AND n <> 1", txt("n"),
       f"if(n = 0, {msg('R-25-A', 0)}, concat({msg('R-25-A', 1)}, n, {msg('R-25-A', 2)}))",
       source=f"{_con_suelo} x ANTI JOIN {_canc} c ON c.fk = x.T_Id")
add("R-25-B", f"cca_terreno t LEFT JOIN cca_predio p ON t.predio = p.T_Id LEFT JOIN {_canc} c ON c.fk = p.T_Id",
    f"p.T_Id IS NULL OR c.fk IS NOT NULL OR NOT {inset('condicion_predio', K.NEEDS_TERRAIN)}", "cca_terreno", "t.T_Id", NP,
    word("condicion_predio"),
    f"CASE WHEN p.T_Id IS NULL THEN {msg('R-25-B', 0)} WHEN NOT {inset('condicion_predio', K.NEEDS_TERRAIN)} "
    f"THEN {msg('R-25-B', 1)} || condicion_predio ELSE {msg('R-25-B', 2)} END")

# ------------------------------------------------------------------ horizontal property
parcel("R-26", "n_ph > 0 AND abs(ifnull(coef, 0) - 1.0) > 0.001", rnd("ifnull(coef, 0)", 4),
       f"{msg('R-26')} || {rnd('ifnull(coef, 0)', 4)}", source="matriz")
parcel("R-27", off("acoef", "suelo_m"), f"concat('suma=', {rnd('ifnull(acoef, 0)', 3)}, ' | geo=', {rnd('suelo_m', 3)})",
       esperado=rnd("suelo_m", 3), source="matriz")
_ph = ["area_total_terreno", "area_total_terreno_privada", "area_total_construida"]
_nulls = [*_ph, "area_total_construida_privada", "area_total_construida_comun", "numero_torres", "total_unidades_privadas"]
parcel("R-28", f"condicion_predio NOT IN ('1', '3') AND coalesce({', '.join(n + '::DOUBLE' for n in _nulls)}) IS NOT NULL",
       "concat(" + ", ".join(f"'{l}', {word(v)}" for l, v in [
           ("aTT=", real(_ph[0])), (" aTTP=", real(_ph[1])), (" aTC=", real(_ph[2])), (" torres=", txt("numero_torres")),
           (" u_priv=", txt("total_unidades_privadas"))]) + ")")
parcel("R-29", "n_ph = 1", "'1'", source="matriz")
parcel("R-30", f"condicion_predio IN ('2', '4') AND ({blank('numero_predial_matriz')} OR NOT ifnull(list_contains(cs, if(condicion_predio = '2', '1', '3')), false))",
       word("numero_predial_matriz"),
       f"CASE WHEN {blank('numero_predial_matriz')} THEN {msg('R-30', 0)} WHEN m IS NULL THEN {msg('R-30', 1)} ELSE {msg('R-30', 2)} END",
       "if(condicion_predio = '2', 'matriz con condicion=1 (PH.Matriz)', 'matriz con condicion=3 (Condominio.Matriz)')",
       source=f"cca_predio LEFT JOIN (SELECT {NP} AS m, list(DISTINCT condicion_predio) AS cs FROM cca_predio GROUP BY ALL) ON m = numero_predial_matriz")
_PLAN = {
    "R-31-A": ("1", "area_total_terreno", "suelo_m"),
    "R-32": ("1", "area_total_construida", "techo_h + techo_m"),
    "R-33": ("1", "area_total_construida_privada", "techo_h"),
    "R-34": ("1", "area_total_construida_comun", "techo_m"),
    "R-37": ("3", "area_total_terreno", "suelo_m + suelo_h"),
    "R-38": ("3", "area_total_terreno_privada", "suelo_h"),
    "R-40": ("3", "area_total_construida", "techo_h + techo_m"),
    "R-41": ("3", "area_total_construida_privada", "techo_h"),
    "R-42": ("3", "area_total_construida_comun", "techo_m"),
}
for _id, (_state, _column, _want) in _PLAN.items():
    parcel(_id, f"condicion_predio = '{_state}' AND {off(_column, _want)}", word(real(_column)), esperado=rnd(_want, 3), source="matriz")
parcel("R-31-C", "condicion_predio = '1' AND area_total_terreno_privada <> 0", real("area_total_terreno_privada"))
parcel("R-35", "condicion_predio = '1' AND ifnull(numero_torres, -1) <> ifnull(torre, -1)", word(txt("numero_torres")),
       esperado=word(txt("torre")), source="matriz")
for _id, _state in (("R-36", "1"), ("R-44", "3")):
    parcel(_id, f"condicion_predio = '{_state}' AND n_h IS DISTINCT FROM total_unidades_privadas", word(txt("total_unidades_privadas")),
           esperado=txt("n_h"), source="matriz")
parcel("R-43", "condicion_predio = '3' AND numero_torres <> 0", txt("numero_torres"))

# ------------------------------------------------------------------ buildings
parcel("RF-01", "condicion_predio = '2' AND n = 0", "'0 UCs'", source=_conteo)


def trait(rule_id: str, where: str, actual: str, mensaje=None, esperado=None) -> None:
    add(rule_id, "puc", where, "cca_caracteristicaucons", "T_Id", NP, actual, mensaje, esperado)


_uso, _en_ph = "uso_unidad_construccion", "condicion_predio IN ('2', '4')"
trait("RF-02", f"{_en_ph} AND NOT {inset(_uso, K.PH_USES)}", _uso)
trait("RF-03", f"NOT {_en_ph} AND {inset(_uso, K.PH_USES)}", _uso)
add("RF-04", "cca_unidadconstruccion u ANTI JOIN cca_predio p ON p.T_Id = u.predio", "true", "cca_unidadconstruccion", "u.T_Id",
    word(txt("predio")), word(txt("predio")), f"if(predio IS NULL, {msg('RF-04', 0)}, {msg('RF-04', 1)})")
add("RF-05", "cca_terreno t LEFT JOIN cca_predio p ON p.T_Id = predio", "AREA < 2.0", "cca_terreno", "t.T_Id", f"ifnull({NP}, 'SIN PREDIO')",
    rnd("AREA", 4))
parcel("RF-06", "f <> 'A'", "f", tid="pid", source=f"(SELECT pid, {NP}, min(identificador) AS f FROM puc GROUP BY ALL)")
for _id, (_type, _label, _first, _last) in USE_DOMAINS.items():
    _allowed = ", ".join(f"'{code}'" for code in range(int(_first), int(_last) + 1))
    trait(_id, f"tipo_construccion = '{_type}' AND {_uso} NOT IN ({_allowed})", _uso)
add("RF-12", "cca_unidadconstruccion u JOIN cca_predio p ON p.T_Id = u.predio", "planta_ubicacion <= 0", "cca_unidadconstruccion", "u.T_Id", NP,
    txt("planta_ubicacion"))
for _id, (_uses, _type, _label, _parcel, _name) in DOMINANT_TYPES.items():
    _mine = f"sum(if(tipo_construccion = '{_type}', area_construida, 0.0))"
    parcel(_id, "n = 0 OR (total > 0 AND propia <= 0.5 * total)",
           f"concat('{_name}=', {rnd('propia', 2)}, ' total=', {rnd('total', 2)})", f"if(n = 0, {msg(_id, 0)}, {msg(_id, 1)})", tid="pid",
           source=f"(SELECT pid, {NP}, {_mine} AS propia, sum(area_construida) AS total, count(*) FILTER (tipo_construccion = '{_type}') AS n "
                  f"FROM puc WHERE {inset('destinacion_economica', _uses)} GROUP BY ALL)")
trait("RF-17", "ifnull(total_plantas, 0) <= 0", word(txt("total_plantas")))
_dos = f"concat('area_construida=', {word(real('area_construida'))}, ' area_privada=', {word(real('area_privada_construida'))})"
trait("RF-18", f"{_en_ph} AND (ifnull(area_construida, 0) <> 0 OR ifnull(area_privada_construida, 0) <= 0)", _dos,
      f"if(ifnull(area_construida, 0) <> 0, {msg('RF-18', 0)}, {msg('RF-18', 1)})")
trait("RF-19", f"NOT {_en_ph} AND (ifnull(area_construida, 0) <= 0 OR area_privada_construida IS NOT NULL)", _dos,
      f"if(ifnull(area_construida, 0) <= 0, {msg('RF-19', 0)}, {msg('RF-19', 1)})")
trait("RF-20", f"NOT {_en_ph} AND area_geo IS NOT NULL AND {off('area_construida', 'area_geo')}",
      f"concat('declarada=', {rnd('area_construida', 3)}, ' geo=', {rnd('area_geo', 3)})", esperado=rnd("area_geo", 3))
parcel("RF-21", off("geo", "decl"), f"concat('geo=', {rnd('geo', 3)}, ' decl=', {rnd('decl', 3)})",
       f"{msg('RF-21', 0)} || identificador || {msg('RF-21', 1)}", rnd("geo", 3), tid="pid",
       source=f"(SELECT pid, {NP}, identificador, sum(area_geo) AS geo, "
              f"ifnull(if({_en_ph}, max(area_privada_construida), max(area_construida)), 0) AS decl "
              f"FROM puc WHERE area_geo IS NOT NULL GROUP BY pid, {NP}, identificador, condicion_predio)")

# ------------------------------------------------------------------ rights
_NAT = "(" + " OR ".join(f"contains({upper('ifnull(quien, chr(32))')}, {q(b)})" for b in K.PUBLIC_BODIES) + ")"


def right(rule_id: str, where: str, actual: str, mensaje=None, esperado=None, source="pdf") -> None:
    add(rule_id, source, where, "cca_derechocatastral", "did", NP, actual, mensaje, esperado)


_ini, _vis = "fecha_inicio_derecho", "fecha_visita_predio"
right("RJ-01", f"{_vis} IS NOT NULL AND ({blank(_ini)} OR {_ini} >= {_vis})", word(_ini),
      f"if({blank(_ini)}, {msg('RJ-01', 0)}, {msg('RJ-01', 1)})", f"'entre 0 y ' || {_vis}", source="pd")
_fmi = "folio_matricula"
parcel("RJ-02-A", f"tipo_predio = '4' AND tipo_derecho = '0' AND condicion_predio <> '9' AND {blank(_fmi)}", word(_fmi), source="pd")
parcel("RJ-02-B", f"condicion_predio = '9' AND tipo_derecho IN ('1', '2') AND {filled(_fmi)}", _fmi, source="pd")
parcel("RJ-03", "tipo_derecho = '2' AND tipo_predio IS DISTINCT FROM '4'", word("tipo_predio"), source="pd")
parcel("RJ-04", "tipo_predio = '4' AND tipo_derecho = '1'", "'tipo_predio=4, tipo_derecho=1'", source="pd")
parcel("RJ-05", "tipo_derecho = '2' AND tipo_predio IN ('0', '1', '2', '3')", "format('tipo_predio={}, tipo_derecho=2', tipo_predio)", source="pd")
parcel("RJ-06", f"tipo_predio = '0' AND tipo_derecho = '0' AND NOT {_NAT}", word("quien"),
       source=f"(SELECT pdi.* FROM pdi LEFT JOIN cca_interesado_agrupacion ia ON ia.agrupacion = pdi.agrupacion) b "
              f"ANTI JOIN (SELECT grupo FROM socio WHERE {_NAT}) g ON g.grupo = b.agrupacion")
add("RJ-07", "pd JOIN cca_agrupacioninteresados a ON a.T_Id = pd.agrupacion JOIN socio s ON s.grupo = a.T_Id",
    "tipo_agrupacion = '2' AND ifnull(s.grupo_etnico, '6') = '6'", "cca_interesado", "s.T_Id", NP, word("s.grupo_etnico"))
parcel("RJ-08", f"tipo_predio = '3' AND tipo_derecho = '1' AND {_NAT}", "quien", source="pdi")
parcel("RJ-08", f"tipo_predio = '3' AND tipo_derecho = '1' AND {_NAT}", "quien", msg("RJ-08", 1), source="pd JOIN socio ON grupo = agrupacion",
       tid="pd.T_Id")
parcel("RJ-09", "tipo_predio IN ('1', '2') AND tipo_derecho = '0' AND interesado IS NOT NULL AND tipo_interesado IS DISTINCT FROM '1'",
       word("tipo_interesado"), source="pdi")
_todos = "cca_predio p LEFT JOIN cca_derechocatastral d ON d.predio = p.T_Id"
parcel("RJ-10", "condicion_predio IN ('8', '10') AND (tipo_predio IS DISTINCT FROM '2' OR d.T_Id IS NULL OR tipo_derecho <> '0')",
       f"concat('tipo_predio=', {word('tipo_predio')}, ' tipo_derecho=', {word('tipo_derecho')})",
       f"if(tipo_predio = '2', {msg('RJ-10', 1)}, {msg('RJ-10', 0)})", source=_todos, tid="p.T_Id")
right("RJ-11", f"{filled(_fmi)} AND fecha_fuente > {_ini}", _ini, esperado="fecha_fuente")
_faltas = ["fuente IS NULL", blank("fecha_fuente"), "tipo_fuente IS NULL", blank("nombre_fuente"), blank("ente_emisor")]
right("RJ-12-A", f"{filled(_fmi)} AND ({' OR '.join(_faltas)})",
      "concat(" + ", ".join(f"'{l}', {word(v)}" for l, v in [
          ("fuente=", txt("fuente")), (" tipo=", "tipo_fuente"), (" nombre=", "nombre_fuente"), (" ente=", "ente_emisor"), (" fecha=", "fecha_fuente")]) + ")",
      "CASE " + " ".join(f"WHEN {c} THEN {msg('RJ-12-A', i)}" for i, c in enumerate(_faltas)) + " END")
add("RJ-12-B", "pdf", f"{filled(_fmi)} AND {_vis} < fecha_fuente", "cca_fuenteadministrativa", "fuente", NP, "fecha_fuente", None, _vis)
parcel("RJ-29", "d.T_Id IS NULL OR coalesce(interesado, agrupacion) IS NULL", "'sin interesado'",
       f"if(d.T_Id IS NULL, {msg('RJ-29', 0)}, {msg('RJ-29', 1)})", source=_todos, tid="p.T_Id")


# ------------------------------------------------------------------ parties, groups, documents
def party(rule_id: str, where: str, name: str, actual: str, mensaje=None, tail="") -> None:
    add(rule_id, "cca_interesado", where, "cca_interesado", "T_Id", name, actual, mensaje, tail=tail)


_nom, _raz, _doc = "nombre_interesado", "razon_social", "numero_documento"
_rn, _nr = f"coalesce({_raz}, {_nom}, 'SIN NOMBRE')", f"coalesce({_nom}, {_raz}, 'SIN NOMBRE')"
_n, _r = f"ifnull({_nom}, 'SIN NOMBRE')", f"ifnull({_raz}, 'SIN RAZON SOCIAL')"
party("RJ-13", "tipo_interesado = '1' AND tipo_documento NOT IN ('2', '6')", _rn, "tipo_documento")
party("RJ-14", "tipo_interesado = '0' AND tipo_documento NOT IN ('0', '1', '3', '4', '5', '6')", _n, "tipo_documento")
party("RJ-15", f"tipo_documento IN ('0', '1', '4', '5') AND ifnull(trim({_doc}), '') IN ('', '0')", _nr, word(_doc),
      f"concat({msg('RJ-15', 0)}, tipo_documento, {msg('RJ-15', 1)})")
party("RJ-16", f"tipo_documento = '2' AND ({blank(_doc)} OR instr({_doc}, '-') = 0)", _rn, word(_doc),
      f"if({blank(_doc)}, {msg('RJ-16', 0)}, {msg('RJ-16', 1)})")
party("RJ-17", f"tipo_interesado = '0' AND {filled(_nom)} AND translate({_nom}, '0123456789@#$&*/.,;:!+=()', '') <> {_nom}", _n, _nom)
party("RJ-18", f"tipo_interesado = '1' AND {filled(_nom)}", _r, _nom)
party("RJ-19", f"tipo_interesado = '0' AND (contains({upper(_nom)}, 'SUC ') OR contains({upper(_nom)}, 'SUC.') OR "
               f"starts_with({upper(_nom)}, 'SUC') OR contains({upper(_nom)}, 'SUCESION'))", _n, _nom)
party("RJ-20", f"tipo_interesado = '0' AND {filled(_raz)}", _n, _raz)
party("RJ-21", "tipo_interesado = '1' AND sexo IS NOT NULL", _r, "sexo")
party("RJ-22", f"tipo_interesado = '0' AND {blank(_nom)} AND {filled(_raz)}", _n, _raz)
_mezcla = ("(SELECT a.T_Id, tipo_agrupacion, nombre_agrupacion, bool_or(tipo_interesado = '0') AS nat, bool_or(tipo_interesado = '1') AS jur "
           "FROM cca_agrupacioninteresados a JOIN socio ON grupo = a.T_Id GROUP BY ALL)")
for _id, _kind, _test in (("RJ-23", "3", "nat AND jur"), ("RJ-24", "0", "nat AND NOT ifnull(jur, false)"), ("RJ-25", "1", "jur AND NOT ifnull(nat, false)")):
    add(_id, _mezcla, f"{_test} AND tipo_agrupacion IS DISTINCT FROM '{_kind}'", "cca_agrupacioninteresados", "T_Id",
        "ifnull(nombre_agrupacion, 'SIN NOMBRE')", word("tipo_agrupacion"))
add("RJ-26", "cca_agrupacioninteresados", "porcentaje_participacion <> 0 AND porcentaje_participacion NOT BETWEEN 0.999 AND 1.001",
    "cca_agrupacioninteresados", "T_Id", "ifnull(nombre_agrupacion, 'SIN NOMBRE')", real("porcentaje_participacion"))
_sn = "ifnull(nombre_fuente, 'SIN NOMBRE')"
add("RJ-27", "cca_fuenteadministrativa",
    f"CASE WHEN tipo_fuente = '4' THEN {filled('ente_emisor')} AND {filled('nombre_fuente')} WHEN tipo_fuente IN ('0', '1', '2', '3') "
    f"THEN {blank('ente_emisor')} OR {blank('nombre_fuente')} OR {blank('fecha_fuente')} END",
    "cca_fuenteadministrativa", "T_Id", _sn,
    f"concat('tipo=', tipo_fuente, ' ente=', {word('ente_emisor')}, ' nombre=', {word('nombre_fuente')}, ' fecha=', {word('fecha_fuente')})",
    f"if(tipo_fuente = '4', {msg('RJ-27', 0)}, {msg('RJ-27', 1)})")
add("RJ-28", "cca_fuenteadministrativa",
    f"{filled('ente_emisor')} AND CASE tipo_fuente WHEN '0' THEN NOT contains({upper('ente_emisor')}, 'NOTARI') "
    f"WHEN '1' THEN NOT regexp_matches({upper('ente_emisor')}, 'JUZGADO|TRIBUNAL|CORTE') END",
    "cca_fuenteadministrativa", "T_Id", _sn, "format('tipo={} ente={}', tipo_fuente, ente_emisor)",
    esperado="if(tipo_fuente = '0', 'ente con NOTARI', 'ente con JUZGADO o TRIBUNAL')")
_llave = upper(f"trim(coalesce({_nom}, {_raz}, ''))")
add("RJ-30", f"(SELECT *, {_llave} AS k FROM cca_interesado) a JOIN (SELECT *, {_llave} AS k FROM cca_interesado) b USING (k)",
    f"b.T_Id > a.T_Id AND b.{_doc} <> a.{_doc} AND ifnull(a.{_nom}, a.{_raz}) <> ''", "cca_interesado", "a.T_Id", f"ifnull(a.{_nom}, a.{_raz})",
    f"format('doc_a={{}} doc_b={{}}', a.{_doc}, b.{_doc})")
party("RJ-31", filled(_doc), _nr, _doc, tail=f"QUALIFY count(*) OVER (PARTITION BY {_doc}) > 1")


# ------------------------------------------------------------------ events
def event(rule_id: str, where: str, actual: str, mensaje=None, esperado=None, source="pn", tid="nid") -> None:
    add(rule_id, source, where, "cca_estructuranovedadnumeropredial", tid, "numero_predial", actual, mensaje, esperado)


def t(values) -> str:
    return inset("tipo_novedad", values)


for _id, _codes in (("RN-01", K.SPLIT), ("RN-06", K.MERGE)):
    parcel(_id, f"{t(_codes)} AND {blank(_fmi)}", word(_fmi), source="pn")
for _id, _codes in (("RN-02", K.SPLIT), ("RN-07", K.MERGE)):
    event(_id, f"{t(_codes)} AND n.numero_predial IS NOT NULL", "numero_predial", tid="n.T_Id",
          source="nv n ANTI JOIN _r1_predios r ON r.numero_predial = n.numero_predial")
parcel("RN-03", f"{t(K.SPLIT)} AND condicion_predio = '9'", "'condicion_predio=9'", source="pn")


def structure(rule_id: str, codes: str, having: str, actual: str) -> None:
    counts = ", ".join(f"count(*) FILTER (tipo_novedad = '{k}') AS n{k}" for k in (2, 3, 4, 5, 7, 8))
    same = ", ".join(f"count(*) FILTER (tipo_novedad = '{k}' AND numero_predial = {NP}) AS m{k}" for k in (2, 7))
    parcel(rule_id, having, actual,
           source=f"(SELECT T_Id, {NP}, count(*) AS n, {counts}, {same} FROM pn WHERE tipo_novedad IN ({codes}) GROUP BY T_Id, {NP})")


structure("RN-04", "'2'", "m2 <> 1", "format('mismo_np={} total={}', m2, n)")
structure("RN-05", "'3', '7'", "m7 <> 1 AND n3 = 0", "format('cancel_mismo={} div_mat={} total={}', m7, n3, n)")
structure("RN-08", "'5', '8'", "n5 > 0 AND n < 3", "format('total={} mantiene={} cancel={}', n, n5, n8)")
structure("RN-09", "'4', '8'", "n4 > 0 AND n < 4", "format('total={} nuevo={} cancel={}', n, n4, n8)")
event("RN-10", t(K.CANCELLATION), q("tipo_novedad cancelación + predio nuevo"), tid="a.T_Id",
      source=f"nv a SEMI JOIN (FROM nv WHERE {t(K.NEW_PARCEL)}) b ON a.fk = b.fk AND a.numero_predial = b.numero_predial")
parcel("RN-11", f"{t(K.CANCELLATION)} AND condicion_predio = '9'", "'condicion_predio=9'", source="pn")
_ambos = f"concat('estructura=', numero_predial, ' predio=', {NP})"
event("RN-12", f"tipo_novedad = '6' AND NOT numero_predial = {NP}", _ambos)
event("RN-13", f"{t(K.CANCELLATION)} AND {blank('observacion')}", q("sin observación"),
      source="pn LEFT JOIN cca_derechocatastral d ON d.predio = pn.T_Id")
parcel("RN-14", f"{t(K.CANCELLATION)} AND coalesce(s.predio, u.predio) IS NOT NULL", "'tiene info espacial'",
       f"if(s.predio IS NULL, {msg('RN-14', 1)}, {msg('RN-14', 0)})", tid="pn.T_Id",
       source="pn LEFT JOIN suelo s ON s.predio = pn.T_Id LEFT JOIN (SELECT DISTINCT predio FROM cca_unidadconstruccion) u ON u.predio = pn.T_Id")
event("RN-15", f"{t(K.NUMBER_CHANGE)} AND (numero_predial = {NP} OR len(list_filter(ids, lambda i: i <> T_Id)) > 0)", _ambos,
      f"if(numero_predial = {NP}, {msg('RN-15', 0)}, {msg('RN-15', 1)})",
      source=f"pn LEFT JOIN (SELECT {NP} AS otro, list(T_Id) AS ids FROM cca_predio WHERE {NP} IS NOT NULL GROUP BY ALL) ON otro = numero_predial")
event("RN-16", t(K.NUMBER_CHANGE), "numero_predial", tid="a.T_Id",
      source=f"nv a SEMI JOIN (FROM nv WHERE {t(K.NEW_PARCEL)}) b ON a.numero_predial = b.numero_predial")
for _id, _codes in (("RN-17", K.NUMBER_CHANGE), ("RN-20", K.NEW_PARCEL)):
    parcel(_id, t(_codes), NP, source=f"pn SEMI JOIN _r1_predios r ON r.numero_predial = {NP}")
event("RN-18", f"{t(K.NEW_PARCEL)} AND NOT numero_predial = {NP}", _ambos)
event("RN-19", t(K.NEW_PARCEL), "numero_predial", source="nv n SEMI JOIN _r1_predios r ON r.numero_predial = n.numero_predial", tid="n.T_Id")
parcel("RN-21", f"{t(K.NEW_PARCEL)} AND condicion_predio = '5'", "'condicion_predio=5'", source="pn")
event("RN-22", "true", "numero_predial", source="_r1_predios r ANTI JOIN nv ON nv.numero_predial = r.numero_predial", tid="NULL::BIGINT")
event("RN-23", "n > 1", txt("n"), tid="lo",
      source=f"(SELECT numero_predial, count(*) AS n, min(T_Id) AS lo FROM nv WHERE {t(K.NUMBER_CHANGE)} GROUP BY ALL)")
for _id, _one, _other in (("RN-24-A", K.SPLIT, K.MERGE), ("RN-25", K.NEW_PARCEL, K.CANCELLATION)):
    event(_id, "una AND otra", "numero_predial", tid="lo",
          source=f"(SELECT numero_predial, min(T_Id) AS lo, bool_or({t(_one)}) AS una, bool_or({t(_other)}) AS otra FROM nv "
                 f"WHERE {t((*_one, *_other))} GROUP BY ALL)")
add("RN-24-B", "(SELECT fk, tipo_novedad, count(*) AS n, min(T_Id) AS lo FROM nv GROUP BY ALL)", "n > 1", "cca_estructuranovedadnumeropredial",
    "lo", txt("fk"), "concat('tipo=', tipo_novedad, ' repeticiones=', n)")
parcel("RN-26", "condicion_predio = '5'", "'condicion=5 (Mejora)'", tid="p.T_Id",
       source=f"cca_predio p SEMI JOIN _r1_predios r ON r.numero_predial = p.{NP} "
              f"ANTI JOIN (FROM nv WHERE {t((*K.NUMBER_CHANGE, *K.CANCELLATION))}) n ON n.fk = p.T_Id")


def prefix() -> str:
    return f"{sample_ctes()},\n{VIEWS}\n"


def rule_sql(rule_id: str) -> str:
    return prefix() + SQL[rule_id]


def _all_rules() -> str:
    parts = []
    for rule in catalogue():
        parts.append(
            f"SELECT {q(rule.id)} AS regla_id, {q(rule.descripcion)} AS regla_descripcion, {q(rule.categoria)} AS categoria, "
            f"{q(rule.severidad)} AS severidad, * FROM ({SQL[rule.id]})"
        )
    return " UNION ALL ".join(parts)


def violations_sql() -> str:
    return prefix() + _all_rules()


def summary_by_rule_sql() -> str:
    rows = ", ".join(f"({q(r.id)}, {q(r.categoria)}, {q(r.severidad)})" for r in catalogue())
    return prefix() + f""", hallazgos AS ({_all_rules()}), reglas(regla_id, categoria, severidad) AS (VALUES {rows})
SELECT r.regla_id, r.categoria, r.severidad, count(h.regla_id) AS n, if(count(h.regla_id) = 0, 'OK', 'FAIL') AS estado
FROM reglas r LEFT JOIN hallazgos h ON h.regla_id = r.regla_id GROUP BY ALL"""


def summary_by_severity_sql() -> str:
    return (f"SELECT severidad, sum(n)::BIGINT AS violaciones, count(*) FILTER (estado = 'FAIL') AS reglas_con_violaciones, "
            f"count(*) AS reglas FROM ({summary_by_rule_sql()}) GROUP BY ALL")


def polygon_area_sql() -> str:
    return prefix() + "SELECT uc_id, round(area_geo, 6) AS area_geo FROM area_uc"


def matrix_rollups_sql() -> str:
    return prefix() + f"""SELECT T_Id AS predio_id, {NP}, n_h AS n_hijas, n_ph AS n_unidades_ph, round(coef, 6) AS suma_coeficiente,
round(acoef, 6) AS suma_area_coeficiente, round(suelo_m, 6) AS area_terreno, round(techo_m, 6) AS area_construcciones,
round(suelo_h, 6) AS terreno_hijas, round(techo_h, 6) AS construido_hijas, torre AS max_torre FROM matriz"""


def load_r1_sql() -> str:
    return prefix() + f"""SELECT DISTINCT trim({NP}) AS numero_predial FROM cca_predio WHERE trim({NP}) <> ''
UNION SELECT 'A' || chr(10) || 'B, "C"'"""


def r1_counts_sql() -> str:
    return prefix() + f"""SELECT count(*) + 1 AS filas, count(DISTINCT numero_predial) + 1 AS distintos
FROM (SELECT trim({NP}) AS numero_predial FROM cca_predio) WHERE numero_predial <> ''"""


def selection_sql(ids: list[str]) -> str:
    """Violations of the rules listed by id."""
    listed = ", ".join(f"'{rule_id}'" for rule_id in ids)
    return f"SELECT * FROM ({violations_sql()}) v WHERE regla_id IN ({listed})"


def category_counts_sql() -> str:
    return f"SELECT categoria, count(*) AS n FROM ({violations_sql()}) v GROUP BY categoria"


def user_rule_sql(limit: int) -> str:
    return prefix() + f"""SELECT 'cca_direccion' AS tabla, d.T_Id AS t_id, p.{NP} AS clave_negocio, 'grande' AS mensaje,
    CAST(d.zona AS VARCHAR) AS valor_actual, '{limit}' AS valor_esperado
FROM cca_predio p JOIN (SELECT c_custkey AS T_Id, c_custkey AS predio, c_nationkey AS zona FROM customer) d ON d.predio = p.T_Id
WHERE d.zona > {limit}"""


def user_rule_column_sql() -> str:
    return prefix() + f"""SELECT 'cca_predio' AS tabla, T_Id AS t_id, {NP} AS clave_negocio, 'sin via' AS mensaje,
    CAST(T_Id % 7 AS VARCHAR) AS valor_actual, CAST(NULL AS VARCHAR) AS valor_esperado FROM cca_predio WHERE T_Id % 7 = 3"""


def isolated_failure_sql() -> str:
    return f"""SELECT 'X-ROTO' AS regla_id, CAST(-1 AS BIGINT) AS n UNION ALL
SELECT 'R-14', (SELECT count(*) FROM ({rule_sql('R-14')}) r) UNION ALL
SELECT 'X-BUENO', (SELECT count(*) FROM ({user_rule_column_sql()}) c)"""


def sink_rerun_sql() -> str:
    """Both severities of the first run, without the category and severity that the second run emptied."""
    return f"""SELECT categoria, severidad, count(*) AS n FROM ({violations_sql()}) v
WHERE categoria IN ('duplicados', 'registral') AND NOT (categoria = 'duplicados' AND severidad = 'advertencia')
GROUP BY categoria, severidad"""


def partial_run_sql(categories: list[str], killed: list[str]) -> str:
    """Counts of the rules outside the killed frame after the cut, of all of them after the run is resumed."""
    listed, lost = (", ".join(f"'{x}'" for x in xs) for xs in (categories, killed))
    return f"""WITH v AS (SELECT regla_id, count(*) AS n FROM ({violations_sql()}) w WHERE categoria IN ({listed}) GROUP BY regla_id)
SELECT 'cortada' AS fase, regla_id, n FROM v WHERE regla_id NOT IN ({lost}) UNION ALL SELECT 'retomada', regla_id, n FROM v"""


def sink_concurrent_sql() -> str:
    """Parcels without folio have no R-18 row; the other rules are counted over them alone in the first run."""
    clean = f"SELECT p.T_Id FROM (SELECT T_Id FROM cca_predio WHERE folio_matricula IS NULL) p"
    numbers = f"SELECT {NP} FROM cca_predio WHERE folio_matricula IS NULL AND {NP} IS NOT NULL"
    return prefix() + f""", sin_folio AS ({clean}), una AS (
    SELECT 'duplicados' AS categoria, 'error' AS severidad, count(*) AS n FROM cca_predio
    WHERE folio_matricula IS NULL AND {NP} IN (SELECT {NP} FROM ({numbers}) GROUP BY 1 HAVING count(*) > 1)
    UNION ALL SELECT 'registral', 'error', count(*) FROM (
        SELECT * FROM ({SQL['R-24-A']}) UNION ALL SELECT * FROM ({SQL['R-24-B']})) r SEMI JOIN sin_folio s ON r.t_id = s.T_Id
), dos AS (
    SELECT 'duplicados' AS categoria, 'error' AS severidad, count(*) AS n FROM ({SQL['R-17']}) a
    UNION ALL SELECT 'duplicados', 'advertencia', count(*) FROM ({SQL['R-18']}) b
)
SELECT 'segunda' AS paso, * FROM dos UNION ALL SELECT 'rechazada', NULL, NULL, 1 UNION ALL SELECT 'rechazada', * FROM dos
UNION ALL SELECT 'primera', * FROM una UNION ALL SELECT 'compacta', * FROM una UNION ALL SELECT 'retiradas', NULL, NULL, 2"""


def registry_lifecycle_sql() -> str:
    return prefix() + """SELECT 'durante' AS momento, count(DISTINCT trim(numero_predial)) AS n FROM _r1_predios
WHERE trim(numero_predial) <> '' AND trim(numero_predial) < '255060000001'
UNION ALL SELECT 'despues', 0 UNION ALL SELECT 'tras_fallo', 0 UNION ALL SELECT 'sin_lista', -1"""


def user_rule_marker_sql(text: str, limit: int) -> str:
    return f"""SELECT 'cca_direccion' AS tabla, c_custkey AS t_id, left(CAST(c_custkey AS VARCHAR), 2) AS clave_negocio,
    {q(text)} AS mensaje, CAST(c_nationkey AS VARCHAR) AS valor_actual, '{limit + 1}' AS valor_esperado
FROM customer WHERE c_nationkey > {limit}"""
