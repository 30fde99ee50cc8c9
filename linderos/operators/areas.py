"""Areas: polygons, matrix roll-ups, dominant shares."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.text import lead_int, one_of
from ..functions.tolerance import out_of_tolerance
from .patterns import piece
from .relations import child_stats, count_where, with_child_stats

SEGMENT = 10_000


# Products of coordinate differences up to this size are added up as decimals: exactly, in any order.
EXACT_BELOW = 1e20
EXACT = "decimal(38,14)"


def exact_sum(term: Column) -> Column:
    """Aggregate: sum of doubles whose result does not depend on their order; the plain sum where a term is too large."""
    return F.when(F.max(F.abs(term)) < EXACT_BELOW, F.sum(F.when(F.abs(term) < EXACT_BELOW, term).cast(EXACT)).cast("double")).otherwise(F.sum(term))


def _cross(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    return ax * by - bx * ay


def polygon_area(vertices: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """Planar area per building unit: outer rings (0) minus holes, over all its polygons (column `parte`, if there is one).

    Shoelace sums in two levels.  A ring is cut into segments of the vertex
    order; each segment yields its own sum and its end points, and a second pass
    links one segment to the next and the last to the first.  A ring of any
    length is thus spread over tasks, and gaps in `seq` do no harm.

    Products are of coordinate differences only, since coordinates of a national
    grid have seven digits before the point and their products lose the square
    millimetres: a segment is measured from its first vertex, and the ring from
    that of its first segment, where a segment with first vertex p and last q
    counts its own sum and (p - origin) x (q - p).
    """
    part = F.coalesce(F.col("parte"), F.lit(0)) if "parte" in vertices.columns else F.lit(0)
    cut = vertices.withColumns({"parte": part, "_seg": F.floor(F.col("seq") / segment)})
    ring = ["uc_id", "parte", "ring"]
    inside = Window.partitionBy(*ring, "_seg").orderBy("seq")
    at = lambda name, f: f(name).over(inside)
    local = cut.select(
        *ring, "_seg", "seq", "x", "y", (F.col("x") - at("x", F.first)).alias("_ax"), (F.col("y") - at("y", F.first)).alias("_ay"),
        (at("x", F.lead) - at("x", F.first)).alias("_bx"), (at("y", F.lead) - at("y", F.first)).alias("_by"),
    )
    segments = local.groupBy(*ring, "_seg").agg(
        F.coalesce(exact_sum(_cross(F.col("_ax"), F.col("_ay"), F.col("_bx"), F.col("_by"))), F.lit(0.0)).alias("_twice"),
        F.min_by(F.struct("x", "y"), "seq").alias("_first"),
        F.max_by(F.struct("x", "y"), "seq").alias("_last"),
    )
    chain = Window.partitionBy(*ring).orderBy("_seg")
    whole = chain.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    origin = F.first("_first").over(whole)
    following = F.coalesce(F.lead("_first").over(chain), origin)
    linked = segments.repartition("uc_id").withColumns({"_next": following, "_origin": origin})
    away = lambda point, name, since="_origin": F.col(f"{point}.{name}") - F.col(f"{since}.{name}")
    along = _cross(away("_first", "x"), away("_first", "y"), away("_last", "x", "_first"), away("_last", "y", "_first"))
    closing = _cross(away("_last", "x"), away("_last", "y"), away("_next", "x"), away("_next", "y"))
    rings = linked.groupBy(*ring).agg((F.abs(exact_sum(F.col("_twice") + along + closing)) / 2).alias("_area"))
    signed = F.when(F.col("ring") == 0, F.col("_area")).otherwise(-F.col("_area"))
    return rings.groupBy("uc_id").agg(F.sum(signed).alias("area_geo"))


def terrain_stats(terrain: DataFrame) -> DataFrame:
    """Per parcel: number of terrain polygons and their area."""
    return child_stats(terrain, "predio", n_terreno=F.count(F.lit(1)), area_terreno=F.sum("AREA"))


def built_stats(buildings: DataFrame, types: tuple[str, ...] = ()) -> DataFrame:
    """Per parcel: built area, first unit label, and area and count per construction type."""
    return child_stats(buildings, "predio", n_construcciones=F.count(F.lit(1)), **built_figures(types))


def built_figures(types: tuple[str, ...], counted: Column | None = None) -> dict[str, Column]:
    """Aggregates over the building units (for which `counted` holds)."""
    counted = F.lit(True) if counted is None else counted
    area = F.when(counted, F.col("area_construida"))
    figures = {"area_construcciones": F.sum(area), "primer_identificador": first_label(F.when(counted, F.col("identificador")))}
    for code in types:
        of_type = F.col("tipo_construccion") == code
        figures[f"area_tipo_{code}"] = F.sum(F.when(counted & of_type, F.col("area_construida")).otherwise(F.lit(0.0)))
        figures[f"n_tipo_{code}"] = count_where(counted & of_type)
    return figures


def label_sums(units: DataFrame) -> DataFrame:
    """Drawn and declared areas per parcel and unit label."""
    return units.groupBy("predio", "identificador").agg(
        F.sum("area_geo").alias("area_geo"),
        F.max("area_construida").alias("area_declarada"),
        F.max("area_privada_construida").alias("area_privada"),
    )


def first_label(column: str | Column) -> Column:
    """Aggregate: smallest label in byte order."""
    return F.min(column)


def matrix_rollups(parcels: DataFrame, terrain: DataFrame, built: DataFrame, units: tuple[str, ...]) -> DataFrame:
    """Figures of the child parcels per parent number, keyed `_parent`.

    Children are summed by the number they point to before any join with the
    parents, so a parent number held by several parcels is summed once.
    """
    children = parcels.filter(F.col("numero_predial_matriz").isNotNull())
    children = with_child_stats(children, "predio_id", terrain)
    children = with_child_stats(children, "predio_id", built)
    return child_rollups(children, units)


def child_rollups(parcels: DataFrame, units: tuple[str, ...]) -> DataFrame:
    """Figures of parcels, their terrain and their built area, per parent number."""
    unit = one_of("condicion_predio", *units)
    return child_stats(
        parcels, "numero_predial_matriz",
        n_hijas=F.count(F.lit(1)),
        n_unidades_ph=count_where(unit),
        suma_coeficiente=F.sum(F.when(unit, F.col("coeficiente_copropiedad"))),
        suma_area_coeficiente=F.sum(F.when(unit, F.col("area_coeficiente"))),
        terreno_hijas=F.sum("area_terreno"),
        construido_hijas=F.sum("area_construcciones"),
        max_torre=F.max(lead_int(piece("numero_predial_nacional", 25, 2))),
    )


def reconcile(declared: Column, expected: Column) -> Column:
    """Declared area outside the standard tolerance of the expected one."""
    return out_of_tolerance(declared, expected)


def sum_equals(total: Column, target: float, epsilon: float) -> Column:
    """Total differs from a constant by more than epsilon."""
    return F.abs(total - target) > epsilon


def max_code_equals(declared: Column, highest: Column) -> Column:
    """Declared count differs from the highest derived code; absent on both sides is equal."""
    absent = F.lit(-1)
    return F.coalesce(declared, absent) != F.coalesce(highest, absent)


def dominant_share(area: Column, total: Column, count: Column, share: float = 0.5) -> Column:
    """No member of the category, or it covers at most `share` of a positive total."""
    return (count == 0) | ((total > 0) & (area <= total * share))
