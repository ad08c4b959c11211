"""Calorie budgets and totals by day, meal and week."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import days_remaining, end_of_week, last_days, start_of_week
from ..functions.numbers import clamp, ratio_percent
from .nutrition import sums, total


def weekly_target(mode: Column, weekly: Column, daily: Column) -> Column:
    return F.when(mode == "weekly", weekly).otherwise(daily * 7)


def _around(diary: DataFrame, as_of: Column) -> DataFrame:
    """Entries that any owner's week with ``as_of`` can hold: a range that reaches the scan."""
    return diary.where(F.col("date").between(F.date_sub(as_of, 6), F.date_add(as_of, 6)))


def week_entries(diary: DataFrame, settings: DataFrame, as_of: Column) -> DataFrame:
    """Entries in their owner's week."""
    weeks = settings.select("owner_id", start_of_week(as_of, F.col("weekStartsOn")).alias("_start"), end_of_week(as_of, F.col("weekStartsOn")).alias("_end"))
    return _around(diary, as_of).join(weeks, "owner_id").where("date between _start and _end").drop("_start", "_end")


def weekly_summary(diary: DataFrame, settings: DataFrame, as_of: Column) -> DataFrame:
    """One row for each owner with settings, also those without entries.

    Energy is summed by owner and day before it meets the settings, so the
    join's input is at most 13 rows for each owner.
    """
    return weekly_summary_of_days(_around(diary, as_of).groupBy("owner_id", "date").agg(F.sum("nutritionSnapshot.kcal").alias("kcal")), settings, as_of)


def weekly_summary_of_days(days: DataFrame, settings: DataFrame, as_of: Column) -> DataFrame:
    """As ``weekly_summary``, of ``days(owner_id, date, kcal)`` that are summed already, as a store keeps them."""
    daily = _around(days, as_of).select("owner_id", "date", "kcal")
    weeks = settings.select(
        "owner_id", "weekStartsOn", start_of_week(as_of, F.col("weekStartsOn")).alias("week_start"), end_of_week(as_of, F.col("weekStartsOn")).alias("week_end"),
        weekly_target(F.col("calorieTargetMode"), F.col("weeklyCalorieTarget"), F.col("dailyCalorieTarget")).alias("target"),
    )
    joined = weeks.join(daily, "owner_id", "left")
    inside = F.when(F.col("date").between(F.col("week_start"), F.col("week_end")), F.col("kcal"))
    out = joined.groupBy("owner_id", "weekStartsOn", "week_start", "week_end", "target").agg(F.coalesce(F.sum(inside), F.lit(0.0)).alias("consumed"))
    remaining, days = F.col("target") - F.col("consumed"), days_remaining(as_of, F.col("weekStartsOn"))
    percent = ratio_percent(F.col("consumed"), F.col("target"))
    return out.select(
        "owner_id", "week_start", "week_end", "target", "consumed", remaining.alias("remaining"), days.alias("remaining_days"),
        (remaining / days).alias("average_available_per_remaining_day"), percent.alias("percent"), clamp(percent).alias("bar"),
    )


def daily_totals(diary: DataFrame) -> DataFrame:
    return total(diary, "owner_id", "date")


def week_totals(diary: DataFrame, settings: DataFrame, as_of: Column) -> DataFrame:
    return total(week_entries(diary, settings, as_of), "owner_id")


def day_progress(diary: DataFrame, settings: DataFrame, as_of: Column) -> DataFrame:
    """The day's energy against the daily target, also in weekly mode; the bar is clamped."""
    eaten = diary.where(F.col("date") == as_of).groupBy("owner_id").agg(F.sum("nutritionSnapshot.kcal").alias("kcal"))
    rows = settings.select("owner_id", F.col("dailyCalorieTarget").alias("target")).join(eaten, "owner_id", "left")
    percent = ratio_percent(F.coalesce("kcal", F.lit(0.0)), F.col("target"))
    return rows.select("owner_id", F.coalesce("kcal", F.lit(0.0)).alias("kcal"), "target", percent.alias("percent"), clamp(percent).alias("bar"))


def meal_totals(diary: DataFrame, settings: DataFrame, as_of: Column) -> DataFrame:
    """The day's energy by the meals that the settings name, in their order; other meals are left out."""
    meals = settings.select("owner_id", F.posexplode("mealNames").alias("position", "meal"))
    eaten = diary.where(F.col("date") == as_of).groupBy("owner_id", "meal").agg(F.sum("nutritionSnapshot.kcal").alias("kcal"))
    return meals.join(eaten, ["owner_id", "meal"], "left").select("owner_id", "position", "meal", F.coalesce("kcal", F.lit(0.0)).alias("kcal"))


def last_days_totals(diary: DataFrame, owners: DataFrame, as_of: Column, days: int = 7) -> DataFrame:
    """Totals of the last days, also of days without entries."""
    spine = owners.select("owner_id", F.explode(last_days(as_of, days)).alias("date"))
    eaten = diary.where(F.col("date").between(F.date_sub(as_of, days - 1), as_of)).groupBy("owner_id", "date").agg(*sums("nutritionSnapshot"))
    return spine.join(eaten, ["owner_id", "date"], "left")


#: The nutrients of the day card and which of them have a target.
CARD = (("proteinG", "proteinG"), ("carbsG", "carbsG"), ("fatG", "fatG"), ("sugarsG", None), ("fiberG", None), ("sodiumMg", None))


def macro_progress(diary: DataFrame, settings: DataFrame, as_of: Column) -> DataFrame:
    """Rows of nutrient, value (0 if unknown), target and percent, in a fixed order."""
    eaten = total(diary.where(F.col("date") == as_of), "owner_id")
    rows = settings.select("owner_id", "macroTargets").join(eaten, "owner_id", "left")
    card = F.array(*[
        F.struct(F.lit(k).alias("position"), F.lit(n).alias("nutrient"), F.coalesce(F.col(n), F.lit(0.0)).alias("value"), (F.col(f"macroTargets.{t}") if t else F.lit(None)).cast("double").alias("target"))
        for k, (n, t) in enumerate(CARD)
    ])
    out = rows.select("owner_id", F.explode(card).alias("m")).select("owner_id", "m.*")
    return out.withColumn("percent", ratio_percent(F.col("value"), F.col("target")))


