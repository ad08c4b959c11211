"""The driver's tables read as foods, intake, diary, weigh-ins, settings, labels and products."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.nutrition import nutrition
from ..operators.portions import diary_snapshots, quick_calories
from ..schemas import DEFAULT_SETTINGS

#: The day that all queries take for today, a Wednesday.
AS_OF = "2024-01-24"


def as_of():
    return F.lit(AS_OF).cast("date")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def all_foods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every food there has been.  Some serving units have the other dimension's measure."""
    k, size = F.col("p_partkey"), F.col("p_size").cast("double")
    volume = k % 4 == 3
    in_ml = volume != (k % 13 == 5)
    basis = F.struct(F.when(volume, "volume").otherwise("mass").alias("type"), F.when(~volume, 100.0).alias("grams"), F.when(volume, 100.0).alias("ml"))
    unit = F.struct(
        F.lit("unit").alias("id"), F.lit("unidade").alias("singular"), F.lit("unidades").alias("plural"), F.lit(4.75).alias("quantity"),
        F.when(~in_ml, size).alias("grams"), F.when(in_ml, size).alias("ml"),
    )
    return table(spark, sf_dir, "part").select(
        k.cast("string").alias("id"), F.col("p_name").alias("name"), F.col("p_brand").alias("brand"),
        F.concat(F.lit("789"), F.lpad(k.cast("string"), 10, "0")).alias("barcode"), basis.alias("nutritionBasis"),
        nutrition(
            kcal=F.col("p_retailprice") / 10, carbsG=F.when(k % 7 != 0, size), proteinG=(k % 30).cast("double"), fatG=(k % 23).cast("double"),
            sodiumMg=F.when(k % 3 == 0, (k % 900).cast("double")), sugarsG=(k % 11).cast("double"), addedSugarsG=F.when(k % 4 != 0, (k % 5).cast("double")),
            saturatedFatG=(k % 13).cast("double"), transFatG=F.when(k % 6 == 0, 0.5), fiberG=(k % 17).cast("double"),
        ).alias("nutrition"),
        F.array(unit).alias("servingUnits"), F.lit("manual").alias("source"), F.lit(None).cast("string").alias("sourceMetadata"),
        F.lit("2023-12-01").cast("timestamp").alias("createdAt"), F.lit("2023-12-01").cast("timestamp").alias("updatedAt"),
    )


def foods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The foods that are left: a tenth is deleted."""
    return all_foods(spark, sf_dir).where(F.col("id").try_cast("long") % 10 != 9)


def intake(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines to be logged; those without a food are quick calories."""
    n = table(spark, sf_dir, "part").count()
    e, food = F.col("event_id"), (F.col("event_id") * 37) % max(n, 1)
    unit = F.when(e % 17 == 3, "cup").when(e % 2 == 0, F.when(food % 4 == 3, "ml").otherwise("g")).otherwise("unit")
    return table(spark, sf_dir, "events").where("event_type <> 'signup'").select(
        e.cast("string").alias("id"), F.col("user_id").alias("owner_id"), F.to_date("ts").alias("date"), F.col("event_type").alias("meal"),
        F.when(e % 11 != 0, food.cast("string")).alias("foodId"), F.col("value").alias("amount"), unit.alias("unitId"), F.col("ts").cast("timestamp").alias("createdAt"),
    )


def diary(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = intake(spark, sf_dir)
    return diary_snapshots(lines, all_foods(spark, sf_dir)).unionByName(quick_calories(lines))


def weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").where("event_type = 'signup'").select(
        F.col("user_id").alias("owner_id"), F.col("event_id").cast("string").alias("id"), F.to_date("ts").alias("date"),
        (50 + F.col("value") / 10).alias("kg"), F.lit(None).cast("string").alias("note"),
    )


def owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("owner_id"))


def settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    level = reduce(lambda c, p: c.when(F.col("c_mktsegment") == p[0], p[1]), [("AUTOMOBILE", "sedentary"), ("BUILDING", "light"), ("FURNITURE", "moderate"), ("HOUSEHOLD", "active")], F.when(F.lit(False), "")).otherwise("very-active")
    daily = (1800 + k % 10 * 50).cast("double")
    target = lambda x: x.cast("double")
    profile = F.struct(
        (60 + k % 40).cast("double").alias("currentWeightKg"), F.when(k % 5 != 0, F.when(k % 9 == 0, 0.0).otherwise((60 + k % 20).cast("double"))).alias("goalWeightKg"),
        F.when(k % 19 != 0, (150 + k % 50).cast("double")).alias("heightCm"), F.date_add(F.lit("1950-01-01").cast("date"), ((k * 97) % 20000).cast("int")).alias("birthDate"),
        F.when(k % 11 == 0, 40.0).alias("age"), F.when(k % 13 != 0, F.when(F.col("c_nationkey") % 2 == 0, "female").otherwise("male")).alias("sex"),
        level.alias("activityLevel"), F.when(k % 7 == 0, 2400.0).alias("manualTdee"), F.lit(None).cast("double").alias("desiredWeightChangeKgPerWeek"),
    )
    return table(spark, sf_dir, "customer").select(
        k.alias("owner_id"), F.lit("settings").alias("id"), F.lit("pt-BR").alias("locale"), F.lit("system").alias("theme"),
        F.array(F.lit("view"), F.lit("click"), F.lit("purchase"), F.lit("Lanches")).alias("mealNames"), (k % 2).cast("int").alias("weekStartsOn"),
        F.when(k % 3 == 0, "weekly").otherwise("daily").alias("calorieTargetMode"), daily.alias("dailyCalorieTarget"), (13000 + k % 20 * 100).cast("double").alias("weeklyCalorieTarget"),
        F.struct(daily.alias("kcal"), target(100 + k % 50).alias("proteinG"), target(200 + k % 60).alias("carbsG"), target(60 + k % 30).alias("fatG")).alias("macroTargets"),
        profile.alias("profile"),
        F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in r.items()]) for r in DEFAULT_SETTINGS["reminders"]]).alias("reminders"),
        F.lit("2024-01-01").cast("timestamp").alias("updatedAt"),
    )


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Label texts with and without their parts, some in capitals."""
    k, size = F.col("p_partkey"), F.col("p_size").cast("string")
    part = lambda keep, *text: F.when(keep, F.concat(*text)).otherwise("")
    text = F.concat(
        part(k % 3 != 0, F.lit("Porção: "), size, F.when(k % 4 == 3, F.lit(" ml")).otherwise(F.lit(" g")), F.lit(" (4,75 unidades.)  ")),
        part(k % 5 != 0, F.when(k % 2 == 0, F.lit("100 g ")).otherwise(F.lit("por 100ml "))),
        F.lit("Valor energético "), size, F.lit(",5 kcal Carboidratos 6."), size, F.lit(" g "),
        part(k % 4 != 0, F.lit("Proteínas "), size, F.lit(" g Sódio "), size, F.lit("mg")),
        part(k % 6 == 1, F.lit(" Açúcares totais 1,25 g Gorduras trans 0,3g Fibra alimentar 2 g")),
    )
    return table(spark, sf_dir, "part").select(k.alias("label_id"), F.when(k % 8 == 2, F.upper(text)).otherwise(text).alias("text"))


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``barcode, json`` of every food there has been, with numbers as numbers and as strings."""
    k, size = F.col("p_partkey"), F.col("p_size").cast("string")
    json = F.concat(
        F.lit('{"product_name": "'), F.when(k % 9 == 0, F.lit("")).otherwise(F.col("p_name")), F.lit('", "brands": "'), F.col("p_brand"),
        F.lit('", "nutriments": {"energy-kcal_100g": '), size, F.lit(', "carbohydrates_100g": "'), size, F.lit(',5", "proteins_100g": "'),
        F.when(k % 4 == 0, F.lit("")).when(k % 4 == 1, F.lit("x1")).otherwise(size), F.lit('", '),
        F.when(k % 2 == 0, F.concat(F.lit('"sodium_100g": 0.'), size)).otherwise(F.concat(F.lit('"sodium_mg_100g": "'), size, F.lit('"'))),
        F.lit(', "sugars_100g": '), (k % 11).cast("string"), F.lit(', "added-sugars_100g": " 1,5 ", "saturated-fat_100g": "1e1", "trans-fat_100g": 0, "fiber_100g": " "}}'),
    )
    return table(spark, sf_dir, "part").select(F.concat(F.lit("789"), F.lpad(k.cast("string"), 10, "0")).alias("barcode"), json.alias("json"))
