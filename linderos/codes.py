"""Coded domains and thresholds.  Fixed values of the land-registry model."""

from __future__ import annotations

from .texts import USE_DOMAINS


def code_range(first: int, last: int) -> tuple[str, ...]:
    return tuple(str(code) for code in range(first, last + 1))


# ---------------------------------------------------------------- fixed values
# Tolerance between a declared and an expected area.
TOLERANCE_SHARE = 0.05
TOLERANCE_M2 = 2.0
TOLERANCE_THRESHOLD_M2 = 500.0

# Department and municipality taken when a parcel names none.
DEFAULT_DEPARTMENT = "25"
DEFAULT_MUNICIPALITY = "506"

# condicion_predio
PH_UNITS = ("2", "4")
MATRICES = ("1", "3")
NEEDS_TERRAIN = ("0", "1", "3", "4", "6", "8", "9", "10")
INFORMAL = "9"
IMPROVEMENT = "5"

# destinacion_economica
NEEDS_BUILDING = ("5", "7", "9", "10", "16", "24")
URBANISED_NOT_BUILT = "19"

# tipo_novedad
NEW_PARCEL = ("0", "1")
SPLIT = ("2", "3")
MERGE = ("4", "5")
CANCELLATION = code_range(6, 12)
NUMBER_CHANGE = code_range(13, 29)

# uso_unidad_construccion reserved for horizontal property
PH_USES = ("0", "5", "7", "8", "9", "12", "14", "16", "18", "22", "25", "28", "31", "36", "38", "40", "42", "55")

# Public bodies, as they appear in upper-cased party names.
PUBLIC_BODIES = ("NACION", "MUNICIPIO", "AGENCIA NACIONAL DE TIERRAS")

# Characters a natural person's name may not hold.
NAME_FORBIDDEN = r"[0-9@#$&*/.,;:!+=()]"
# ------------------------------------------------------------ end fixed values

USES_BY_TYPE = {type_code: code_range(first, last) for type_code, _, first, last in USE_DOMAINS.values()}
