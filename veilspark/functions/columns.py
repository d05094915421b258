"""Column expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normal(c: Column | str) -> Column:
    """Normal form of a label: trimmed of any white space and lower-cased; null stays null."""
    c = F.col(c) if isinstance(c, str) else c
    return F.lower(F.regexp_replace(c, r"(?U)^\s+|\s+$", ""))


def hash_fraction(*columns: Column | str, seed: int = 0) -> Column:
    """A hash of the columns as a number in [0, 1) with 53 bits, so that any share of the rows can be asked for."""
    return F.shiftrightunsigned(F.xxhash64(*columns, F.lit(seed)), 11) / F.lit(float(1 << 53))


def has_text(c: Column | str) -> Column:
    """True where a text holds at least one sign that isn't white space."""
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(c.rlike(r"(?U)\S"), F.lit(False))
