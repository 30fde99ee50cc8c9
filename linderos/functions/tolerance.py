"""Area tolerance between a declared and an expected value."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ..codes import TOLERANCE_M2, TOLERANCE_SHARE, TOLERANCE_THRESHOLD_M2


def out_of_tolerance(
    declared: Column,
    expected: Column,
    share: float = TOLERANCE_SHARE,
    absolute: float = TOLERANCE_M2,
    threshold: float = TOLERANCE_THRESHOLD_M2,
) -> Column:
    """Strictly beyond `absolute`, or beyond `share` of large expected areas; NULL counts as 0."""
    zero = F.lit(0.0)
    want = F.coalesce(expected, zero)
    gap = F.abs(F.coalesce(declared, zero) - want)
    return gap > F.when(want > threshold, want * share).otherwise(F.lit(absolute))
