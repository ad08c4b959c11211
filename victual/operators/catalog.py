"""Finding foods: recent, frequent, suggested, searched, by barcode."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TOP = 8


def _used(diary: DataFrame) -> DataFrame:
    return diary.where(F.col("foodId").isNotNull() & (F.col("foodId") != ""))


def _of_foods(ranked: DataFrame, foods: DataFrame) -> DataFrame:
    """Inner join after the limit, so a deleted food shortens the list."""
    return ranked.join(foods.select(F.col("id").alias("foodId"), "name"), "foodId").select("owner_id", "rank", "foodId", "name")


def recent_foods(diary: DataFrame, foods: DataFrame, top: int = TOP) -> DataFrame:
    """The foods last logged, by their latest entry; of entries of one moment the first by date and id counts."""
    last = _used(diary).groupBy("owner_id", "foodId").agg(F.max("createdAt").alias("at"), F.min_by(F.struct("date", "id"), F.struct(F.coalesce(-F.unix_micros("createdAt"), F.lit(1 << 62)), F.col("date"), F.col("id"))).alias("first"))
    order = Window.partitionBy("owner_id").orderBy(F.desc("at"), "first")
    return _of_foods(last.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top), foods)


def frequent_foods(diary: DataFrame, foods: DataFrame, top: int = TOP) -> DataFrame:
    """The foods logged most; ties go to the one seen first by date and id."""
    counts = _used(diary).groupBy("owner_id", "foodId").agg(F.count("*").alias("n"), F.min(F.struct("date", "id")).alias("first"))
    order = Window.partitionBy("owner_id").orderBy(F.desc("n"), "first")
    return _of_foods(counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top), foods)


def suggestions(diary: DataFrame, foods: DataFrame, top: int = TOP) -> DataFrame:
    """Recent foods, then the frequent ones that aren't among them."""
    recent = recent_foods(diary, foods, top)
    rest = frequent_foods(diary, foods, top).join(recent, ["owner_id", "foodId"], "left_anti")
    section = lambda df, k: df.select("owner_id", F.lit(k).alias("section"), "rank", "foodId", "name")
    return section(recent, 0).unionByName(section(rest, 1))


def matches(needle: Column) -> Column:
    """Whether the needle, trimmed and lower-cased, is in a food's name, brand or barcode; an empty one is in all."""
    low = F.lower(F.regexp_replace(needle, r"(?U)^\s+|\s+$", ""))
    found = [F.coalesce(F.contains(F.lower(F.col(c)), low), F.lit(False)) for c in ("name", "brand", "barcode")]
    return (low == "") | found[0] | found[1] | found[2]


def search(foods: DataFrame, needle: str) -> DataFrame:
    return foods.where(matches(F.lit(needle)))


def log_search(needle: str, diary: DataFrame, foods: DataFrame, top: int = TOP) -> DataFrame:
    """What the log screen lists, as ``owner_id, section, rank, foodId, name``: suggestions for an empty needle, else found foods of all owners (null)."""
    if not needle.strip():
        return suggestions(diary, foods, top)
    null = lambda kind: F.lit(None).cast(kind)
    return search(foods, needle).select(null("long").alias("owner_id"), null("int").alias("section"), null("int").alias("rank"), F.col("id").alias("foodId"), "name")


def by_id(table: DataFrame, wanted: DataFrame, *keys: str) -> DataFrame:
    """The rows of a table with the keys of ``wanted``; unknown keys give none."""
    return table.join(wanted.select(*keys), list(keys), "left_semi")


def by_barcode(foods: DataFrame, codes: DataFrame) -> DataFrame:
    """The first food (by name, then id) of each of ``codes(barcode)``."""
    first = foods.where("barcode is not null").groupBy("barcode").agg(F.min(F.struct("name", "id")).alias("f"))
    return codes.join(first, "barcode").select("barcode", F.col("f.id").alias("id"), F.col("f.name").alias("name"))


def resolve_barcodes(codes: DataFrame, foods: DataFrame, products: DataFrame) -> DataFrame:
    """Foods of one's own first; of the codes left, normalised ``products``; of the rest, nothing."""
    own = by_barcode(foods, codes).select("barcode", "name", F.lit("local").alias("origin"))
    left = codes.join(own, "barcode", "left_anti")
    found = left.join(products.select("barcode", "name"), "barcode").select("barcode", "name", F.lit("open-food-facts").alias("origin"))
    return own.unionByName(found)
