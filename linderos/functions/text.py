"""Text and number-to-text expressions; all JVM-side built-ins."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def sql_text(value: str) -> str:
    """A SQL string literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def one_of(column: str, *codes: str) -> Column:
    """Column among text codes, as one expression however many codes there are."""
    return F.expr(f"`{column}` IN ({', '.join(sql_text(code) for code in codes)})")


def blank(c: Column | str) -> Column:
    """NULL, empty or only spaces (no other whitespace)."""
    return col(c).isNull() | (F.trim(col(c)) == "")


def filled(c: Column | str) -> Column:
    return F.trim(col(c)) != ""


def ascii_upper(c: Column | str) -> Column:
    """Upper-case a-z only; accented letters stay as they are."""
    return F.translate(col(c), "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")


def lead_int(c: Column | str) -> Column:
    """Leading integer of a text, 0 where there is none, NULL for NULL."""
    digits = F.regexp_extract(F.trim(col(c)), r"^[+-]?[0-9]+", 0)
    return F.when(col(c).isNotNull(), F.coalesce(digits.try_cast("int"), F.lit(0)))


def int_text(c: Column | str) -> Column:
    return col(c).cast("string")


def number_text(value: Column) -> Column:
    """A double with 15 significant digits, always with a decimal point.

    Magnitudes from 1e-4 up to 1e15 are written in plain notation, others with
    a two-digit exponent ('4.0e-06').
    """
    scientific = F.format_string("%.14e", value)
    plain = F.regexp_replace(scientific.try_cast("decimal(38,18)").cast("string"), r"(\.[0-9]+?)0+$", "$1")
    exponent = F.regexp_replace(scientific, r"(\.[0-9]+?)0+e", "$1e")
    size = F.abs(value)
    fits = (size == 0) | ((size >= 1e-4) & (size < 1e15))
    return F.when(value.isNotNull() & ~F.isnan(value), F.when(fits, plain).otherwise(exponent))


@dataclass(frozen=True)
class Piece:
    """A label followed by a value; `missing` stands in for a NULL value."""

    label: str = ""
    value: Column | None = None
    real: bool = False
    missing: str | None = None

    def shown(self) -> Column:
        text = number_text(self.value) if self.real else self.value
        return text if self.missing is None else F.coalesce(text, F.lit(self.missing))


class Words(tuple):
    """Text of a violation as pieces, so that many rules can share one formatting step.

    A lone unlabelled piece is NULL where its value is; otherwise NULLs print as
    their stand-in or as nothing.
    """

    def plain(self) -> bool:
        return len(self) == 1 and not self[0].label and self[0].value is not None

    def column(self) -> Column:
        if self.plain():
            return self[0].shown()
        cells = []
        for piece in self:
            cells.append(F.lit(piece.label))
            if piece.value is not None:
                cells.append(piece.shown())
        return F.concat_ws("", *cells)


def words(value: "Words | Column | str") -> Words:
    """Literal, text column or words, as words."""
    if isinstance(value, Words):
        return value
    if isinstance(value, str):
        return Words([Piece(label=value)])
    return Words([Piece(value=value)])


def real_text(c: Column | str) -> Words:
    return Words([Piece(value=col(c).cast("double"), real=True)])


def rounded_text(c: Column | str, digits: int) -> Words:
    """Round half away from zero, then write the number."""
    return real_text(F.round(col(c).cast("double"), digits))


def or_null(value: "Words | Column | str") -> Words:
    """The value, or the word NULL."""
    pieces = words(F.col(value) if isinstance(value, str) else value)
    return Words([replace(piece, missing="NULL") for piece in pieces])


def labelled(*parts: "str | tuple[str, Words | Column]") -> Words:
    """Literals and labelled values in a row; a NULL value prints as nothing."""
    pieces = []
    for part in parts:
        if isinstance(part, str):
            pieces.append(Piece(label=part))
        else:
            label, value = part
            (piece,) = words(value)
            pieces.append(replace(piece, label=label, value=piece.value if piece.real else piece.value.cast("string")))
    return Words(pieces)
