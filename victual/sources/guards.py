"""What a row must hold to be stored: its keys, and numbers that are finite.

The rules come from the table's schema and are one projection, so they're checked as rows are written.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schemas import KEYS, schema


def _infinite(value: Column, kind: T.DataType) -> Column | None:
    """Whether a value holds a number that isn't finite; None if it can't."""
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return F.coalesce(F.isnan(value) | (F.abs(value) == float("inf")), F.lit(False))
    if isinstance(kind, T.StructType):
        found = [c for f in kind.fields if (c := _infinite(value[f.name], f.dataType)) is not None]
        out = None
        for c in found:
            out = c if out is None else out | c
        return out
    if isinstance(kind, T.ArrayType) and _infinite(F.lit(None), kind.elementType) is not None:
        return F.coalesce(F.exists(value, lambda x: _infinite(x, kind.elementType)), F.lit(False))
    return None


def rules(name: str) -> dict[str, Column]:
    """For each rule of a table, whether a row breaks it."""
    out = {f"{key}: missing": F.col(key).isNull() for key in KEYS[name]}
    for field in schema(name).fields:
        if (broken := _infinite(F.col(field.name), field.dataType)) is not None:
            out[f"{field.name}: not finite"] = broken
    return out


def breaches(name: str) -> Column:
    """The rules that a row breaks, as texts."""
    return F.array_compact(F.array(*[F.when(broken, rule) for rule, broken in rules(name).items()]))


def rejected(name: str, rows: DataFrame) -> DataFrame:
    """Rows that can't be stored, with ``reasons``."""
    return rows.withColumn("reasons", breaches(name)).where("size(reasons) > 0")
