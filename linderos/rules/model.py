"""What a rule is.

A rule is one or more parts.  A part names a frame (an input relation, see
`plans.frames`), the extra features it reads from it, and a row check over its
columns.  Rules on the same frame can therefore share one pass over the data.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import Words
from ..texts import TEXTS

PARCELS = "cca_predio"
UNITS = "cca_unidadconstruccion"
UNIT_TRAITS = "cca_caracteristicaucons"
TERRAINS = "cca_terreno"
RIGHTS = "cca_derechocatastral"
PARTIES = "cca_interesado"
GROUPS = "cca_agrupacioninteresados"
SOURCES = "cca_fuenteadministrativa"
EVENTS = "cca_estructuranovedadnumeropredial"


# A literal, a text column, or pieces of both.
Said = str | Column | Words


@dataclass(frozen=True)
class Check:
    """Row check: where it fails and what the violation says."""

    when: Column
    tabla: str
    t_id: Column
    clave: Said
    actual: Said
    mensaje: Said | None = None
    esperado: Said | None = None


@dataclass(frozen=True)
class Part:
    frame: str
    check: Callable[[], Check]
    uses: frozenset[str] = frozenset()


@dataclass(frozen=True)
class Rule:
    """A catalogue entry: parts, or for user rules a DataFrame builder or SQL text.

    `sql` must select the six finding columns in order; `parametros` are bound
    as typed values to its `:name` markers, or, if it has none, put in with
    str.format.  A `build` function gets the run's tables.
    """

    id: str
    descripcion: str
    categoria: str
    severidad: str = "error"
    parts: tuple[Part, ...] = ()
    build: Callable[..., DataFrame] | None = None
    sql: str | None = None
    parametros: dict = field(default_factory=dict)


class Category:
    """Collects the built-in rules of one category, in order."""

    def __init__(self, name: str):
        self.name = name
        self.rules: list[Rule] = []

    def rule(self, rule_id: str, frame: str, *uses: str, categoria: str | None = None):
        """Register the decorated check as a rule, or as one more part of it."""

        def register(check: Callable[[], Check]):
            text = TEXTS[rule_id]

            def filled() -> Check:
                found = check()
                return replace(
                    found,
                    mensaje=text.mensaje if found.mensaje is None else found.mensaje,
                    esperado=text.esperado if found.esperado is None else found.esperado,
                )

            part = Part(frame, filled, frozenset(uses))
            if self.rules and self.rules[-1].id == rule_id:
                self.rules[-1] = replace(self.rules[-1], parts=self.rules[-1].parts + (part,))
            else:
                self.rules.append(Rule(rule_id, text.descripcion, categoria or self.name, text.severidad, (part,)))
            return check

        return register


def message(rule_id: str, which: int = 0) -> Column:
    return F.lit(TEXTS[rule_id].mensajes[which])


def on_parcel(when: Column, actual: Said, mensaje: Said | None = None, esperado: Said | None = None) -> Check:
    """Violation reported on the parcel itself."""
    return Check(when, PARCELS, F.col("predio_id"), F.col("numero_predial_nacional"), actual, mensaje, esperado)
