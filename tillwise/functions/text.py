"""Display text. ``format_number`` rounds the exact binary value half-even."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CURRENCY = "₹"
LAKH = 100000.0


def grouped(value: Column, digits: int = 0) -> Column:
    """Thousands separators and a fixed number of decimals."""
    return F.format_number(value.cast("double"), digits)


def plain(value: Column, digits: int) -> Column:
    return F.replace(grouped(value, digits), F.lit(","), F.lit(""))


def money_text(value: Column) -> Column:
    return F.concat(F.lit(CURRENCY), grouped(value, 0))


def lakh_text(value: Column) -> Column:
    return F.concat(F.lit(CURRENCY), plain(value / F.lit(LAKH), 1), F.lit("L"))


def suffixed(value: Column, digits: int, suffix: str) -> Column:
    return F.concat(plain(value, digits), F.lit(suffix))


def signed_percent(value: Column) -> Column:
    return F.concat(F.when(value >= 0, F.lit("+")).otherwise(F.lit("")), suffixed(value, 1, "%"))


def code(prefix: str, width: int, number: Column) -> Column:
    """``ORD000001``-style identifiers."""
    return F.format_string(f"{prefix}%0{width}d", number)


def contact_handle(name: Column) -> Column:
    return F.replace(F.lower(name), F.lit(" "), F.lit("."))


def quoted(value: str) -> str:
    """A SQL text literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"
