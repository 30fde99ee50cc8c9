"""Schemas of the input tables and of the violations table."""

from __future__ import annotations

from pyspark.sql import types as T

_TYPES = {"long": T.LongType(), "int": T.IntegerType(), "double": T.DoubleType(), "string": T.StringType()}


def _struct(spec: str) -> T.StructType:
    fields = (item.split(":") for item in spec.split())
    return T.StructType([T.StructField(name, _TYPES[kind], True) for name, kind in fields])


TABLES: dict[str, T.StructType] = {
    "cca_predio": _struct(
        "T_Id:long numero_predial_nacional:string condicion_predio:string departamento_municipio:string "
        "numero_predial_matriz:string folio_matricula:string codigo_orip:string area_registral_m2:double "
        "destinacion_economica:string coeficiente_copropiedad:double area_coeficiente:double "
        "area_total_terreno:double area_total_terreno_privada:double area_total_construida:double "
        "area_total_construida_privada:double area_total_construida_comun:double numero_torres:int "
        "total_unidades_privadas:int tipo_predio:string fecha_visita_predio:string"
    ),
    "cca_terreno": _struct("T_Id:long predio:long AREA:double"),
    "cca_unidadconstruccion": _struct("T_Id:long predio:long caracteristica:long planta_ubicacion:int"),
    "cca_caracteristicaucons": _struct(
        "T_Id:long identificador:string tipo_construccion:string uso_unidad_construccion:string "
        "area_construida:double area_privada_construida:double total_plantas:int"
    ),
    "cca_derechocatastral": _struct(
        "T_Id:long predio:long tipo_derecho:string fecha_inicio_derecho:string interesado:long "
        "agrupacion:long fuente:long observacion:string"
    ),
    "cca_interesado": _struct(
        "T_Id:long tipo_interesado:string tipo_documento:string numero_documento:string "
        "nombre_interesado:string razon_social:string sexo:string grupo_etnico:string"
    ),
    "cca_agrupacioninteresados": _struct(
        "T_Id:long tipo_agrupacion:string nombre_agrupacion:string porcentaje_participacion:double"
    ),
    "cca_interesado_agrupacion": _struct("agrupacion:long interesado:long"),
    "cca_fuenteadministrativa": _struct(
        "T_Id:long tipo_fuente:string nombre_fuente:string ente_emisor:string fecha_fuente:string"
    ),
    "cca_estructuranovedadnumeropredial": _struct(
        "T_Id:long cca_predio_novedad_numero_predial:long tipo_novedad:string numero_predial:string"
    ),
    "_r1_predios": _struct("numero_predial:string"),
    "uc_vertices": _struct("uc_id:long ring:int seq:int x:double y:double"),
}

# Columns that a table may have beyond those.
OPTIONAL: dict[str, T.StructType] = {"uc_vertices": _struct("parte:int")}

# The six columns a rule yields, in order.
FINDING = ("tabla", "t_id", "clave_negocio", "mensaje", "valor_actual", "valor_esperado")

VIOLATION = T.StructType(
    [T.StructField(name, T.StringType(), False) for name in ("regla_id", "regla_descripcion", "categoria", "severidad", "tabla")]
    + [T.StructField("t_id", T.LongType(), True)]
    + [T.StructField(name, T.StringType(), True) for name in FINDING[2:]]
    + [T.StructField("fecha_validacion", T.StringType(), False)]
)
