"""Portions: from an amount in some unit to grams or millilitres, and to nutrients.

Permissive results carry an ``error`` and no nutrients; ``strict`` raises.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .nutrition import nutrition, scale
from .skew import salted_join

UNKNOWN_UNIT, NO_RELATION, MISMATCH, NO_FOOD, ZERO = "unit-not-found", "unit-without-measure", "dimension-mismatch", "food-not-found", "zero-divisor"


def grams_per_unit(unit: Column) -> Column:
    return F.try_divide(unit["grams"], unit["quantity"])


def ml_per_unit(unit: Column) -> Column:
    return F.try_divide(unit["ml"], unit["quantity"])


def unit_label(unit: Column, amount: Column) -> Column:
    return F.when(F.abs(amount) == 1, unit["singular"]).otherwise(unit["plural"])


def available_units(foods: DataFrame) -> DataFrame:
    """``food_id, position, unit_id, label``: the base unit, then the serving units in order."""
    base = F.when(F.col("nutritionBasis.type") == "mass", "g").otherwise("ml")
    first = F.array(F.struct(base.alias("id"), base.alias("label")))
    rest = F.transform(F.coalesce("servingUnits", F.array()), lambda u: F.struct(u["id"].alias("id"), u["plural"].alias("label")))
    units = foods.select(F.col("id").alias("food_id"), F.posexplode(F.concat(first, rest)).alias("position", "unit"))
    return units.select("food_id", "position", F.col("unit.id").alias("unit_id"), "unit.label")


def with_portion(rows: DataFrame, strict: bool = False) -> DataFrame:
    """Adds ``portion`` (grams, ml, label, nutrition, error) to rows of ``food``, ``amount`` and ``unitId``.

    A base unit wins over a serving unit of the same id; a serving unit's grams
    win over its millilitres.  A zero quantity or basis gives no nutrients.
    """
    food, amount, unit_id = F.col("food"), F.col("amount"), F.col("unitId")
    mass, volume = food["nutritionBasis"]["type"] == "mass", food["nutritionBasis"]["type"] == "volume"
    unit = F.get(F.filter(food["servingUnits"], lambda u: u["id"] == unit_id), F.lit(0))
    rows = rows.withColumn("_unit", unit)
    unit = F.col("_unit")
    base_g, base_ml = F.coalesce(mass & (unit_id == "g"), F.lit(False)), F.coalesce(volume & (unit_id == "ml"), F.lit(False))
    by_g, by_ml = unit["grams"].isNotNull(), unit["grams"].isNull() & unit["ml"].isNotNull()
    rows = rows.withColumns(
        {
            "_grams": F.when(base_g, amount).when(~base_ml & by_g, amount * grams_per_unit(unit)),
            "_ml": F.when(base_g, F.lit(None)).when(base_ml, amount).when(by_ml, amount * ml_per_unit(unit)),
            "_label": F.when(base_g, "g").when(base_ml, "ml").otherwise(unit_label(unit, amount)),
        }
    )
    basis = F.when(mass, food["nutritionBasis"]["grams"]).otherwise(food["nutritionBasis"]["ml"])
    consumed = F.when(mass, F.col("_grams")).otherwise(F.col("_ml"))
    measured = base_g | base_ml | F.when(mass, by_g).otherwise(by_ml)
    error = (
        F.when(food.isNull(), NO_FOOD)
        .when(~base_g & ~base_ml & unit.isNull(), UNKNOWN_UNIT)
        .when(~base_g & ~base_ml & ~by_g & ~by_ml, NO_RELATION)
        .when(~measured, MISMATCH)
        .when(F.try_divide(consumed, basis).isNull() & amount.isNotNull(), ZERO)
    )
    if strict:
        error = F.when(error.isNotNull(), F.raise_error(error).cast("string"))
    portion = F.struct(
        F.col("_grams").cast("double").alias("grams"), F.col("_ml").cast("double").alias("ml"), F.col("_label").alias("label"),
        scale(food["nutrition"], F.try_divide(consumed, basis)).alias("nutrition"), error.alias("error"),
    )
    return rows.withColumn("portion", portion).drop("_unit", "_grams", "_ml", "_label")


def resolve(intake: DataFrame, foods: DataFrame, strict: bool = False, salted: bool = False) -> DataFrame:
    """Intake lines beside their foods, with portions.  Foods are one row for each id.

    ``salted`` reads the lines once more to find foods that a great part of them name, and spreads those out.
    """
    known = foods.select(F.col("id").alias("foodId"), F.struct(*[F.col(c) for c in ("id", "name", "nutritionBasis", "nutrition", "servingUnits")]).alias("food"))
    lines = intake.where(F.col("foodId").isNotNull())
    return with_portion(salted_join(lines, known, "foodId", "left") if salted else lines.join(known, "foodId", "left"), strict)


def diary_snapshots(intake: DataFrame, foods: DataFrame, strict: bool = False, salted: bool = False) -> DataFrame:
    """Diary rows with the food's name and scaled nutrients as of now; lines with an error are left out."""
    done = resolve(intake, foods, strict, salted).where(F.col("portion.error").isNull())
    return done.select(
        "owner_id", "id", "date", "meal", "foodId", F.col("food.name").alias("foodName"), "amount", "unitId", F.col("portion.label").alias("unitLabel"),
        F.col("portion.grams").alias("grams"), F.col("portion.ml").alias("ml"), F.col("portion.nutrition").alias("nutritionSnapshot"), "createdAt",
    )


def quick_calories(intake: DataFrame, label: str = "Quick calories") -> DataFrame:
    """Diary rows of lines without a food: the amount is the energy."""
    return intake.where(F.col("foodId").isNull()).select(
        "owner_id", "id", "date", "meal", F.lit(None).cast("string").alias("foodId"), F.lit(label).alias("foodName"), "amount",
        F.lit("kcal").alias("unitId"), F.lit("kcal").alias("unitLabel"), F.lit(None).cast("double").alias("grams"), F.lit(None).cast("double").alias("ml"),
        nutrition(kcal=F.col("amount")).alias("nutritionSnapshot"), "createdAt",
    )
