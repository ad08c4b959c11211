"""Sparse nutrient structs: scaling and summing.  Null is "unknown" throughout."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import NUTRIENTS


def nutrition(**values: Column) -> Column:
    """A nutrition struct with the given nutrients and the others unknown."""
    return F.struct(*[values.get(n, F.lit(None)).cast("double").alias(n) for n in NUTRIENTS])


def scale(of: Column, factor: Column) -> Column:
    return F.struct(*[(of[n] * factor).alias(n) for n in NUTRIENTS])


def sums(of: str) -> list[Column]:
    """Aggregates by nutrient; a nutrient that is never known stays unknown."""
    return [F.sum(F.col(f"{of}.{n}")).alias(n) for n in NUTRIENTS]


def total(entries: DataFrame, *by: str) -> DataFrame:
    """Totals of the diary entries' snapshots, by the given columns."""
    return entries.groupBy(*by).agg(*sums("nutritionSnapshot"))
