"""Searching foods by an inverted index of three-letter grams, where a scan of every food is too slow.

A field is taken with two zero letters after it, so whatever stands in it, however short, is how
one of its grams begins.  The index only says which foods may match: ``catalog.matches`` decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .catalog import matches

GRAM = 3
_END = "\0" * (GRAM - 1)


def _grams(low: Column) -> Column:
    """All grams of a lower-cased text, its last letters too; none of an empty or missing one."""
    text = F.concat(low, F.lit(_END))
    at = F.sequence(F.lit(1), F.length(low))
    return F.coalesce(F.when(F.length(low) > 0, F.transform(at, lambda i: F.substring(text, i, F.lit(GRAM)))), F.array().cast("array<string>"))


def index(foods: DataFrame) -> DataFrame:
    """``gram, id``: each gram of a food's name, brand and barcode once."""
    grams = F.array_distinct(F.concat(*[_grams(F.lower(c)) for c in ("name", "brand", "barcode")]))
    return foods.select(F.explode(grams).alias("gram"), "id")


def write_index(foods: DataFrame, path: str) -> None:
    """Write the index in the order of its grams, so that a needle's grams lie in a few row groups."""
    index(foods).repartitionByRange("gram", "id").sortWithinPartitions("gram", "id").write.parquet(path)


def _trimmed(needle: Column) -> Column:
    return F.lower(F.regexp_replace(needle, r"(?U)^\s+|\s+$", ""))


def search(foods: DataFrame, grams: DataFrame, needle: str) -> DataFrame:
    """The foods that ``catalog.search`` finds, by way of the index ``grams``; its filters reach the scan."""
    low = foods.sparkSession.range(1).select(_trimmed(F.lit(needle))).first()[0]
    if not low:
        return foods
    parts = sorted({low[i : i + GRAM] for i in range(len(low) - GRAM + 1)})
    if parts:
        found = grams.where(F.col("gram").isin(parts)).groupBy("id").agg(F.count("*").alias("n")).where(F.col("n") == len(parts))
    else:
        found = grams.where(F.startswith("gram", F.lit(low))).select("id").distinct()
    return foods.join(found, "id", "left_semi").where(matches(F.lit(needle)))


def search_many(foods: DataFrame, grams: DataFrame, needles: DataFrame) -> DataFrame:
    """``needle`` beside each food that it finds, for any number of ``needles(needle)``.  An empty one asks for the whole table and is left out.

    A needle's rarest gram alone is joined with the index, so a needle meets the foods with that gram and no others.
    """
    asked = needles.select("needle").distinct().withColumn("_low", _trimmed(F.col("needle")))
    whole = asked.where(F.length("_low") >= GRAM)
    parts = whole.select("needle", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("_low") - (GRAM - 1)), lambda i: F.substring(F.col("_low"), i, F.lit(GRAM))))).alias("gram"))
    counted = parts.join(grams.join(parts.select("gram").distinct(), "gram", "left_semi").groupBy("gram").agg(F.count("*").alias("n")), "gram", "left")
    rarest = counted.groupBy("needle").agg(F.min(F.struct(F.coalesce("n", F.lit(0)), F.col("gram").alias("gram"))).alias("least")).select("needle", F.col("least.gram").alias("gram"))
    found = [rarest.join(grams, "gram").select("needle", "id")]
    for n in range(1, GRAM):
        short = asked.where(F.length("_low") == n).select("needle", F.col("_low").alias("gram"))
        found.append(grams.select(F.substring("gram", 1, n).alias("gram"), "id").distinct().join(short, "gram").select("needle", "id"))
    candidates = found[0]
    for more in found[1:]:
        candidates = candidates.unionByName(more)
    return candidates.join(foods, "id").where(matches(F.col("needle")))
