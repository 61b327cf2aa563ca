"""Tillwise: retail and support operations analytics as Spark DataFrame plans."""

from tillwise.operators.selection import Filters, Period

__all__ = ["Filters", "Period"]
