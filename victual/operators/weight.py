"""Weigh-ins: trends, changes and chart points.  Order is by date, then id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import fixed

_ORDER = ("date", "id")


def moving_average(weights: DataFrame, window: int = 7) -> DataFrame:
    """``trendKg``: the mean of up to ``window`` entries (not days) that end with this one."""
    frame = Window.partitionBy("owner_id").orderBy(*_ORDER).rowsBetween(1 - window, 0)
    return weights.withColumn("trendKg", F.avg("kg").over(frame))


def current_trend(weights: DataFrame, window: int = 7) -> DataFrame:
    """Each owner's last ``trendKg``."""
    return moving_average(weights, window).groupBy("owner_id").agg(F.max_by("trendKg", F.struct(*_ORDER)).alias("trendKg"))


def latest(weights: DataFrame) -> DataFrame:
    """Each owner's last entry, future dates included."""
    last = F.max_by(F.struct("id", "date", "kg"), F.struct(*_ORDER)).alias("last")
    return weights.groupBy("owner_id").agg(last).select("owner_id", "last.*")


def change_over_days(weights: DataFrame, days: int, as_of: Column) -> DataFrame:
    """Latest less the last entry up to ``days`` days ago: 0 if that is the latest, null if there is none.

    One aggregate gives both ends; no self-join.
    """
    old = F.col("date") <= F.date_sub(as_of, days)
    key = F.struct(*_ORDER)
    both = weights.groupBy("owner_id").agg(F.max_by("kg", key).alias("kg"), F.max_by(F.when(old, F.col("kg")), F.when(old, key)).alias("prior"))
    return both.select("owner_id", (F.col("kg") - F.col("prior")).alias("change"))


def known_on(days: DataFrame, weights: DataFrame) -> DataFrame:
    """``days(owner_id, date, ...)`` with ``kg``, the last weight known on that day (null before the first): a backward as-of join.

    Of weigh-ins of one day the greatest id counts; those without a weight count for nothing.  Days and weigh-ins
    are merged in order of date and the last weight is carried on, so nothing is joined by range.  They are merged
    month by month, and each month starts with the weight that is known when it begins; so an owner with very many rows isn't one task's.
    """
    known = weights.where("kg is not null").groupBy("owner_id", "date").agg(F.max_by("kg", "id").alias("kg"))
    month = F.trunc("date", "month").alias("_month")
    ends = known.groupBy("owner_id", month).agg(F.max_by("kg", "date").alias("kg"))
    asked = days.select("owner_id", month).distinct().select("owner_id", "_month", F.lit(None).cast("double").alias("kg"))
    months = ends.unionByName(asked).groupBy("owner_id", "_month").agg(F.max("kg").alias("kg"))
    before = Window.partitionBy("owner_id").orderBy("_month").rowsBetween(Window.unboundedPreceding, -1)
    starts = months.withColumn("kg", F.last("kg", ignorenulls=True).over(before)).where("kg is not null")
    marks = known.select("owner_id", month, "date", "kg", F.lit(1).alias("_kind")).unionByName(starts.select("owner_id", "_month", F.lit(None).cast("date").alias("date"), "kg", F.lit(0).alias("_kind")))
    rows = days.select("owner_id", month, "date", F.struct(*days.columns).alias("_day"), F.lit(2).alias("_kind"))
    so_far = Window.partitionBy("owner_id", "_month").orderBy("date", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    carried = marks.unionByName(rows, allowMissingColumns=True).withColumn("_known", F.last("kg", ignorenulls=True).over(so_far))
    return carried.where("_kind = 2").select("_day.*", F.col("_known").alias("kg"))


def goal_remaining(weights: DataFrame, settings: DataFrame) -> DataFrame:
    """Latest less goal; owners without a goal (or a goal of 0) are left out."""
    goals = settings.select("owner_id", F.col("profile.goalWeightKg").alias("goal")).where("goal is not null and goal <> 0")
    return latest(weights).join(goals, "owner_id").select("owner_id", "kg", "goal", (F.col("kg") - F.col("goal")).alias("remaining"))


def chart_points(weights: DataFrame, value: str = "kg") -> DataFrame:
    """``x`` and ``y`` in a 100 x 100 box of each entry's ``value``; owners with one entry have none."""
    mine = Window.partitionBy("owner_id")
    rows = weights.withColumns(
        {
            "index": F.row_number().over(mine.orderBy(*_ORDER)) - 1,
            "n": F.count("*").over(mine),
            "low": F.min(value).over(mine),
            "high": F.max(value).over(mine),
        }
    ).where("n > 1")
    spread = F.when(F.col("high") == F.col("low"), F.lit(1.0)).otherwise(F.col("high") - F.col("low"))
    x = F.col("index") / (F.col("n") - 1) * 100
    y = F.lit(100.0) - (F.col(value) - F.col("low")) / spread * 86 - 7
    return rows.select("owner_id", "index", x.alias("x"), y.alias("y"))


def line_path(weights: DataFrame, value: str = "kg") -> DataFrame:
    """Each owner's points as one path, ``M`` to the first and ``L`` to the others; empty below two points."""
    step = F.concat(F.when(F.col("index") == 0, "M").otherwise("L"), fixed(F.col("x")), F.lit(" "), fixed(F.col("y")))
    paths = chart_points(weights, value).groupBy("owner_id").agg(F.array_sort(F.collect_list(F.struct("index", step.alias("step")))).alias("steps"))
    paths = paths.select("owner_id", F.array_join(F.transform("steps", lambda s: s["step"]), " ").alias("path"))
    return weights.select("owner_id").distinct().join(paths, "owner_id", "left").fillna("", ["path"])
