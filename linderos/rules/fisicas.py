"""Building units: uses, storeys, areas and labels."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ..codes import PH_UNITS, PH_USES, USES_BY_TYPE
from ..functions.text import int_text, labelled, one_of, or_null, real_text, rounded_text
from ..operators.areas import dominant_share, reconcile
from ..operators.patterns import domain_by_type, require
from ..texts import DOMINANT_TYPES, USE_DOMAINS
from .model import TERRAINS, UNIT_TRAITS, UNITS, Category, Check, message, on_parcel

category = Category("fisicas")


def in_ph() -> Column:
    return one_of("condicion_predio", *PH_UNITS)


def on_traits(when: Column, actual: Column, mensaje=None, esperado=None) -> Check:
    return Check(
        when, UNIT_TRAITS, F.col("caracteristica"), F.col("numero_predial_nacional"), actual, mensaje, esperado
    )


@category.rule("RF-01", "perfil", "unidades")
def _():
    return on_parcel(require(F.col("condicion_predio") == "2", F.col("n_unidades") == 0), "0 UCs")


@category.rule("RF-02", "construccion")
def _():
    use = F.col("uso_unidad_construccion")
    return on_traits(require(in_ph(), ~one_of("uso_unidad_construccion", *PH_USES)), use)


@category.rule("RF-03", "construccion")
def _():
    use = F.col("uso_unidad_construccion")
    return on_traits(require(~in_ph(), one_of("uso_unidad_construccion", *PH_USES)), use)


@category.rule("RF-04", "unidad_predio")
def _():
    parcel = F.col("predio")
    text = F.when(parcel.isNull(), message("RF-04", 0)).otherwise(message("RF-04", 1))
    shown = or_null(int_text(parcel))
    return Check(F.col("existe_predio").isNull(), UNITS, F.col("unidad_id"), shown, shown, text)


@category.rule("RF-05", "terreno_predio")
def _():
    area = F.col("AREA")
    number = F.coalesce("numero_predial_nacional", F.lit("SIN PREDIO"))
    return Check(area < 2.0, TERRAINS, F.col("terreno_id"), number, rounded_text(area, 4))


@category.rule("RF-06", "perfil", "construcciones")
def _():
    first = F.col("primer_identificador")
    return on_parcel(first != "A", first)


def use_rule(rule_id: str) -> None:
    @category.rule(rule_id, "construccion")
    def _():
        kind = USE_DOMAINS[rule_id][0]
        use = "uso_unidad_construccion"
        return on_traits(domain_by_type("tipo_construccion", kind, use, USES_BY_TYPE[kind]), F.col(use))


for _id in USE_DOMAINS:
    use_rule(_id)


@category.rule("RF-12", "unidad_predio")
def _():
    floor = F.col("planta_ubicacion")
    return Check(
        require(F.col("existe_predio"), floor <= 0), UNITS, F.col("unidad_id"), F.col("numero_predial_nacional"), int_text(floor)
    )


def dominance_rule(rule_id: str) -> None:
    @category.rule(rule_id, "perfil", "construcciones")
    def _():
        uses, kind, _, _, name = DOMINANT_TYPES[rule_id]
        area, total, count = F.col(f"area_tipo_{kind}"), F.col("area_construcciones_bruta"), F.col(f"n_tipo_{kind}")
        text = F.when(count == 0, message(rule_id, 0)).otherwise(message(rule_id, 1))
        return on_parcel(
            require(one_of("destinacion_economica", *uses), dominant_share(area, total, count)),
            labelled((f"{name}=", rounded_text(area, 2)), (" total=", rounded_text(total, 2))),
            text,
        )


for _id in DOMINANT_TYPES:
    dominance_rule(_id)


@category.rule("RF-17", "construccion")
def _():
    floors = F.col("total_plantas")
    return on_traits(floors.isNull() | (floors <= 0), or_null(int_text(floors)))


def declared_areas() -> Column:
    return labelled(
        ("area_construida=", or_null(real_text("area_construida"))),
        (" area_privada=", or_null(real_text("area_privada_construida"))),
    )


@category.rule("RF-18", "construccion")
def _():
    built, private = F.col("area_construida"), F.col("area_privada_construida")
    has_built = F.coalesce(built, F.lit(0.0)) != 0
    text = F.when(has_built, message("RF-18", 0)).otherwise(message("RF-18", 1))
    return on_traits(require(in_ph(), has_built | private.isNull() | (private <= 0)), declared_areas(), text)


@category.rule("RF-19", "construccion")
def _():
    built, private = F.col("area_construida"), F.col("area_privada_construida")
    no_built = built.isNull() | (built <= 0)
    text = F.when(no_built, message("RF-19", 0)).otherwise(message("RF-19", 1))
    return on_traits(require(~in_ph(), no_built | private.isNotNull()), declared_areas(), text)


@category.rule("RF-20", "construccion", "geometria")
def _():
    built, drawn = F.col("area_construida"), F.col("area_geo")
    return on_traits(
        require(~in_ph(), drawn.isNotNull(), reconcile(built, drawn)),
        labelled(("declarada=", rounded_text(built, 3)), (" geo=", rounded_text(drawn, 3))),
        esperado=rounded_text(drawn, 3),
    )


@category.rule("RF-21", "construccion_grupo")
def _():
    drawn = F.col("area_geo")
    declared = F.coalesce(F.when(in_ph(), F.col("area_privada")).otherwise(F.col("area_declarada")), F.lit(0.0))
    return on_parcel(
        reconcile(drawn, declared),
        labelled(("geo=", rounded_text(drawn, 3)), (" decl=", rounded_text(declared, 3))),
        F.concat(message("RF-21", 0), F.col("identificador"), message("RF-21", 1)),
        rounded_text(drawn, 3),
    )
