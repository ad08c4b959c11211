"""Energy expenditure: basal rate and total, from a profile."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.dates import age_on
from ..schemas import ACTIVITY


def basal_rate(kg: Column, cm: Column, age: Column, sex: Column) -> Column:
    """Mifflin-St Jeor."""
    return kg * 10 + cm * 6.25 - age * 5 + F.when(sex == "male", 5.0).otherwise(-161.0)


def multiplier(level: Column) -> Column:
    pairs = [F.lit(x) for pair in ACTIVITY.items() for x in pair]
    return F.try_element_at(F.create_map(*pairs), level)


def _given(value: Column) -> Column:
    """Missing or 0 is not given."""
    return value.isNotNull() & (value != 0)


def energy(profile: Column, as_of: Column) -> Column:
    """``struct<bmr, tdee, reason>``: a manual total wins and has no basal rate; an age wins over a birth date."""
    age = F.coalesce(profile["age"], age_on(profile["birthDate"], as_of).cast("double"))
    kg, cm, sex = profile["currentWeightKg"], profile["heightCm"], profile["sex"]
    complete = _given(kg) & _given(cm) & _given(age) & F.coalesce(sex != "", F.lit(False))
    manual = _given(profile["manualTdee"])
    bmr = basal_rate(kg, cm, age, sex)
    return F.struct(
        F.when(~manual & complete, bmr).alias("bmr"),
        F.when(manual, profile["manualTdee"]).when(complete, bmr * multiplier(profile["activityLevel"])).alias("tdee"),
        F.when(manual, "manual").when(complete, "mifflin-st-jeor").otherwise("missing-inputs").alias("reason"),
    )
