"""Row checks: each returns the Column that is true where a row breaks the rule.

SQL's three-valued logic is kept on purpose: a comparison with NULL is unknown,
so such a row is not reported.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce
from operator import and_

from pyspark.sql import Column, functions as F

from ..functions.text import col, one_of


def piece(c: Column | str, position: int, length: int) -> Column:
    """Substring, 1-based; empty beyond the end."""
    return F.substring(col(c), position, length)


def substring_equals(c: Column | str, position: int, length: int, expected: str) -> Column:
    return piece(c, position, length) != expected


def substring_pattern(c: Column | str, *tests: tuple[int, int, Callable[[Column], Column]]) -> Column:
    """Not every piece passes its test; tests are (position, length, check)."""
    return ~reduce(and_, (check(piece(c, position, length)) for position, length, check in tests))


def length_equals(c: Column | str, length: int) -> Column:
    return F.char_length(col(c)) != length


def prefix_of(reference: Column | str, position: int, length: int, default: str) -> Column:
    """The row's own expected code, or the default where the row names none."""
    return F.coalesce(piece(reference, position, length), F.lit(default))


def prefix_matches(c: Column | str, position: int, length: int, reference: Column | str, default: str) -> Column:
    return piece(c, position, length) != prefix_of(reference, position, length, default)


def require(when: Column, *breaks: Column) -> Column:
    """Rows in scope (`when`) for which every one of `breaks` holds."""
    return reduce(and_, breaks, when)


def domain_by_type(type_column: str, type_code: str, value_column: str, allowed: Iterable[str]) -> Column:
    """Value outside the codes allowed for its type."""
    return (F.col(type_column) == type_code) & ~one_of(value_column, *allowed)


def text_matches(c: Column | str, regex: str) -> Column:
    return col(c).rlike(regex)


def date_order(left: str, relation: str, right: str) -> Column:
    """Compare ISO text dates; `relation` is one of < <= > >=."""
    a, b = F.col(left), F.col(right)
    return {"<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[relation]
