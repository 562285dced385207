"""Amounts: integers of the smallest unit as DECIMAL(20, 0), exact text with eight decimals."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UNIT = 100_000_000


def total(value: Column) -> Column:
    """Sum, 0 of no rows."""
    return F.coalesce(F.sum(value), F.lit(0)).cast("decimal(30,0)")


def amount_text(value: Column) -> Column:
    """Exact text with eight decimals and the sign; a product with 1e-8 would lose the last digit."""
    return (value.cast("decimal(30,0)") / F.lit(UNIT).cast("decimal(9,0)")).cast("decimal(38,8)").cast("string")
