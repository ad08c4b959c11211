"""Joins on keys of which a few hold much of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key with more than this share of the rows is heavy; a sketch finds all such keys, of which there are at most its inverse.
SHARE = 0.01
SALTS = 64


def heavy_keys(rows: DataFrame, key: str, share: float = SHARE) -> list:
    """All values with more than ``share`` of the rows, and perhaps some with less: at most 1 / ``share``, found in one pass."""
    found = rows.select(key).freqItems([key], share).first()
    return sorted(v for v in (found[0] or []) if v is not None) if found else []


def salted_join(left: DataFrame, right: DataFrame, key: str, how: str = "inner", share: float = SHARE, salts: int = SALTS) -> DataFrame:
    """``left`` joined with ``right`` on ``key`` ("inner" or "left"), where keys that are heavy in ``left`` are spread over ``salts`` partitions.

    Only rows of ``right`` with a heavy key are copied for each salt.  A left row's salt is drawn from its place, so rows that are alike are spread as well.
    """
    heavy = heavy_keys(left, key, share)
    if not heavy:
        return left.join(right, key, how)
    is_heavy = F.coalesce(F.col(key).isin(heavy), F.lit(False))
    salted = left.where(is_heavy).withColumn("_salt", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(salts)).cast("int"))
    copies = right.where(is_heavy).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    hot = salted.join(copies, [key, "_salt"], how).drop("_salt")
    return hot.unionByName(left.where(~is_heavy).join(right.where(~is_heavy), key, how))
