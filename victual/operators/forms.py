"""What is typed into forms: foods, serving units, settings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import parse_decimal
from ..schemas import NUTRIENTS

NO_NAME, NO_BASIS, BAD_UNIT = "name-required", "basis-required", "unit-incomplete"


def trimmed(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)^\s+|\s+$", "")


def optional(text: Column) -> Column:
    return F.nullif(trimmed(text), F.lit(""))


def new_id(*parts: Column) -> Column:
    """An id for what has none, drawn from what it's made of, so that reruns agree."""
    return F.sha2(F.concat_ws("\n", *[p.cast("string") for p in parts]).cast("binary"), 256)


def clean_unit(unit: Column, basis_type: Column, position: Column) -> Column:
    """A serving unit of typed fields: only the basis' measure stays, names and the id have defaults."""
    mass = basis_type == "mass"
    one, many = trimmed(unit["singular"]), trimmed(unit["plural"])
    return F.struct(
        F.coalesce(F.nullif(unit["id"], F.lit("")), new_id(one, unit["quantity"], position)).alias("id"),
        F.coalesce(F.nullif(one, F.lit("")), F.lit("unidade")).alias("singular"),
        F.coalesce(F.nullif(many, F.lit("")), F.concat(one, F.lit("s"))).alias("plural"),
        parse_decimal(unit["quantity"]).alias("quantity"),
        F.when(mass, parse_decimal(unit["grams"])).alias("grams"),
        F.when(~mass, parse_decimal(unit["ml"])).alias("ml"),
    )


def clean_foods(forms: DataFrame, now: Column, strict: bool = False) -> DataFrame:
    """Foods of typed fields (strings): ``id, name, brand, barcode, basisType, basisAmount, nutrients, servingUnits``.

    ``nutrients`` is a map; what isn't a number is unknown.  ``source, sourceMetadata,
    createdAt``, where there are such columns, are those of the food or draft that was
    edited, and stay; else a food is typed in now.  ``updatedAt`` is now, a missing id is
    drawn from the food.  ``error`` is the first thing that keeps a row from being saved;
    ``strict`` raises it.
    """
    kept = lambda name, kind: F.col(name) if name in forms.columns else F.lit(None).cast(kind)
    amount = parse_decimal(F.col("basisAmount"))
    mass = F.col("basisType") == "mass"
    basis = F.struct(F.when(mass, "mass").otherwise("volume").alias("type"), F.when(mass, amount).alias("grams"), F.when(~mass, amount).alias("ml"))
    nutrition = F.struct(*[parse_decimal(F.try_element_at("nutrients", F.lit(n))).alias(n) for n in NUTRIENTS])
    units = F.transform("servingUnits", lambda u, i: clean_unit(u, F.col("basisType"), i))
    out = forms.withColumns({"nutritionBasis": basis, "nutrition": nutrition, "servingUnits": units})
    measure = lambda u: F.coalesce(u["grams"], u["ml"])
    incomplete = F.exists("servingUnits", lambda u: u["quantity"].isNull() | measure(u).isNull())
    error = F.when(amount.isNull(), NO_BASIS).when(incomplete, BAD_UNIT).when(trimmed(F.col("name")) == "", NO_NAME)
    if strict:
        error = F.when(error.isNotNull(), F.raise_error(error).cast("string"))
    name, brand, barcode = trimmed(F.col("name")), optional(F.col("brand")), optional(F.col("barcode"))
    return out.select(
        F.coalesce(F.nullif("id", F.lit("")), new_id(name, F.coalesce(brand, F.lit("")), F.coalesce(barcode, F.lit("")))).alias("id"),
        name.alias("name"), brand.alias("brand"), barcode.alias("barcode"), "nutritionBasis", "nutrition", "servingUnits",
        F.coalesce(kept("source", "string"), F.lit("manual")).alias("source"), kept("sourceMetadata", "string").alias("sourceMetadata"),
        F.coalesce(kept("createdAt", "timestamp"), now).alias("createdAt"), now.alias("updatedAt"), error.alias("error"),
    )


def given(rows: DataFrame, typed: str, into: str) -> DataFrame:
    """The rows whose typed number is one, with it as ``into``: amounts, energy and weigh-ins without one aren't saved."""
    return rows.withColumn(into, parse_decimal(F.col(typed))).where(F.col(into).isNotNull())


def loggable(rows: DataFrame, foods: DataFrame, typed: str = "typed", into: str = "amount") -> DataFrame:
    """The lines that can be logged: their food is there, and their typed amount is a number."""
    return given(rows, typed, into).join(foods.select(F.col("id").alias("foodId")), "foodId", "left_semi").select(*[c for c in rows.columns if c != into], into)


def prefill(existing: DataFrame, drafts: DataFrame) -> DataFrame:
    """Each field of a food, else of its draft, else the default; joined by id.

    Nutrients are the food's or the draft's as a whole.  The draft's provenance is handed on.
    """
    basis = F.struct(F.lit("mass").alias("type"), F.lit(100.0).alias("grams"), F.lit(None).cast("double").alias("ml"))
    both = existing.alias("e").join(drafts.alias("d"), F.col("e.id") == F.col("d.id"), "full")
    pick = lambda c, *default: F.coalesce(F.col(f"e.{c}"), F.col(f"d.{c}"), *default).alias(c)
    return both.select(
        pick("id"), pick("name", F.lit("")), pick("brand", F.lit("")), pick("barcode", F.lit("")), pick("nutritionBasis", basis), pick("nutrition"), pick("servingUnits"),
        pick("source", F.lit("manual")), pick("sourceMetadata"), F.col("e.createdAt").alias("createdAt"),
    )


def derive_settings(settings: DataFrame, daily: str = "dailyInput", weekly: str = "weeklyInput", meals: str = "mealsInput") -> DataFrame:
    """Settings after an edit: in daily mode the weekly target follows; blank meal lines go."""
    d, w = F.coalesce(parse_decimal(F.col(daily)), F.lit(0.0)), F.coalesce(parse_decimal(F.col(weekly)), F.lit(0.0))
    return settings.withColumns(
        {
            "dailyCalorieTarget": d,
            "weeklyCalorieTarget": F.when(F.col("calorieTargetMode") == "daily", d * 7).otherwise(w),
            "macroTargets": F.col("macroTargets").withField("kcal", d),
            "mealNames": F.filter(F.split(F.col(meals), "\n"), lambda m: m != ""),
        }
    )
