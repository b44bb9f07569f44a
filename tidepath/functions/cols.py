"""Missing-value triage and guarded arithmetic as plain Spark expressions.

Everywhere in this package "missing" is NULL. Files may hold NaN or infinities; these helpers turn them
into NULL where an operator asks for usable numbers.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

INF = float("inf")


def present(c: Column) -> Column:
    """The double, or NULL for NULL and NaN. Infinities stay."""
    d = c.cast("double")
    return F.when(~F.isnan(d), d)


def finite(c: Column) -> Column:
    """The double, or NULL for NULL, NaN and infinities."""
    d = c.cast("double")
    return F.when(~F.isnan(d) & (F.abs(d) < F.lit(INF)), d)


def positive(c: Column) -> Column:
    """The double if it is finite and above zero, else NULL."""
    d = finite(c)
    return F.when(d > 0, d)


def ratio(a: Column, b: Column) -> Column:
    """a / b, NULL where b is NULL or zero."""
    return F.when(b != 0, a / b)


def clip(c: Column, lo: float, hi: float) -> Column:
    """c limited to [lo, hi]; NULL stays NULL (greatest and least alone would skip it)."""
    return F.when(c.isNotNull(), F.least(F.greatest(c, F.lit(lo)), F.lit(hi)))


def day(c: Column) -> Column:
    """YYYY-MM-DD."""
    return F.date_format(c, "yyyy-MM-dd")
