"""The registered queries over the driver's tables, and the same in DuckDB SQL.

Doubles are rounded to six digits on both sides, as sums depend on their order.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import dates, numbers
from ..operators import budget, catalog, energy, forms, labels, portions, products, search, skew, weight
from ..schemas import NUTRIENTS
from ..sources import backup, fixtures as fx, guards, store
from ..sources.work import shared_folder, written
from ..streaming import daily
from .oracles import SQL as ORACLE_SQL, backup_cases  # noqa: F401

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(function):
    QUERIES[function.__name__] = function
    return function


def _r(column: str | Column, name: str | None = None) -> Column:
    value = F.col(column) if isinstance(column, str) else column
    return numbers.round_display(value, 6).alias(name or (column if isinstance(column, str) else ""))


def _exact(column: str, name: str | None = None) -> Column:
    """As ``_r``, to eight digits: the tables' values have seven at most, so exact sums and those of doubles are rounded alike."""
    return numbers.round_display(F.col(column), 8).alias(name or column)


def _nutrients(of: str = "") -> list[Column]:
    return [_r(F.col(of + n), n) for n in NUTRIENTS]


@query
def portion_resolution(spark, sf):
    done = portions.resolve(fx.intake(spark, sf), fx.foods(spark, sf))
    return done.select("id", "foodId", "unitId", _r("portion.grams", "grams"), _r("portion.ml", "ml"), "portion.label", *_nutrients("portion.nutrition."), "portion.error")


@query
def diary_snapshot(spark, sf):
    rows = portions.diary_snapshots(fx.intake(spark, sf), fx.all_foods(spark, sf))
    return rows.select("owner_id", "id", "date", "meal", "foodId", "foodName", _r("amount"), "unitId", "unitLabel", _r("grams"), _r("ml"), *_nutrients("nutritionSnapshot."))


@query
def quick_calories(spark, sf):
    rows = portions.quick_calories(fx.intake(spark, sf))
    return rows.select("owner_id", "id", "date", "meal", "foodName", "unitId", "unitLabel", _r("nutritionSnapshot.kcal", "kcal"), _r("nutritionSnapshot.carbsG", "carbsG"))


@query
def available_units(spark, sf):
    return portions.available_units(fx.foods(spark, sf))


@query
def units_per_piece(spark, sf):
    unit = F.get("servingUnits", F.lit(0))
    return fx.foods(spark, sf).select("id", _r(portions.grams_per_unit(unit), "grams"), _r(portions.ml_per_unit(unit), "ml"), numbers.round_display(F.coalesce(portions.grams_per_unit(unit), F.lit(0.0))).alias("preview"), portions.unit_label(unit, F.lit(-1.0)).alias("one"), portions.unit_label(unit, F.lit(2.0)).alias("many"))


@query
def weekly_budget_summary(spark, sf):
    """Flagship: each owner's budget for the week."""
    out = budget.weekly_summary(fx.diary(spark, sf), fx.settings(spark, sf), fx.as_of())
    return out.select("owner_id", "week_start", "week_end", _r("target"), _r("consumed"), _r("remaining"), "remaining_days", _r("average_available_per_remaining_day"))


@query
def daily_nutrition(spark, sf):
    return budget.daily_totals(fx.diary(spark, sf)).select("owner_id", "date", *_nutrients())


@query
def week_nutrition(spark, sf):
    return budget.week_totals(fx.diary(spark, sf), fx.settings(spark, sf), fx.as_of()).select("owner_id", *_nutrients())


@query
def day_progress(spark, sf):
    out = budget.day_progress(fx.diary(spark, sf), fx.settings(spark, sf), fx.as_of())
    return out.select("owner_id", _r("kcal"), _r("target"), _r("percent"), _r("bar"))


@query
def meal_totals(spark, sf):
    return budget.meal_totals(fx.diary(spark, sf), fx.settings(spark, sf), fx.as_of()).select("owner_id", "position", "meal", _r("kcal"))


@query
def last_seven_days(spark, sf):
    return budget.last_days_totals(fx.diary(spark, sf), fx.owners(spark, sf), fx.as_of()).select("owner_id", "date", *_nutrients())


@query
def macro_progress(spark, sf):
    out = budget.macro_progress(fx.diary(spark, sf), fx.settings(spark, sf), fx.as_of())
    return out.select("owner_id", "position", "nutrient", _r("value"), _r("target"), _r("percent"))


@query
def diary_scan(spark, sf):
    """Entries of one day, latest first."""
    rows = fx.diary(spark, sf).where(F.col("date") == fx.as_of())
    place = F.row_number().over(Window.partitionBy("owner_id").orderBy(F.desc("date"), F.desc("id")))
    return rows.withColumn("position", place).orderBy("owner_id", "position").select("owner_id", "position", "id", "meal", "foodName")


@query
def diary_history(spark, sf):
    """Each owner's entries in their order."""
    place = F.row_number().over(Window.partitionBy("owner_id").orderBy(*store.ORDER["diaryEntries"]))
    return fx.diary(spark, sf).select("owner_id", place.alias("position"), "id", "date", "foodName")


@query
def week_progress(spark, sf):
    out = budget.weekly_summary(fx.diary(spark, sf), fx.settings(spark, sf), fx.as_of())
    return out.select("owner_id", _r("percent"), _r("bar"))


@query
def weight_moving_average(spark, sf):
    return weight.moving_average(fx.weights(spark, sf)).select("owner_id", "id", "date", _r("kg"), _r("trendKg"))


@query
def weight_latest(spark, sf):
    return weight.latest(fx.weights(spark, sf)).select("owner_id", "id", "date", _r("kg"))


@query
def weight_change_7d(spark, sf):
    return weight.change_over_days(fx.weights(spark, sf), 7, fx.as_of()).select("owner_id", _r("change"))


@query
def weight_change_30d(spark, sf):
    return weight.change_over_days(fx.weights(spark, sf), 30, fx.as_of()).select("owner_id", _r("change"))


@query
def goal_remaining(spark, sf):
    return weight.goal_remaining(fx.weights(spark, sf), fx.settings(spark, sf)).select("owner_id", _r("kg"), _r("goal"), _r("remaining"))


@query
def weight_chart_points(spark, sf):
    return weight.chart_points(fx.weights(spark, sf)).select("owner_id", F.col("index").cast("int").alias("index"), _r("x"), _r("y"))


@query
def weight_chart_path(spark, sf):
    return weight.line_path(fx.weights(spark, sf)).select("owner_id", "path")


@query
def weight_trend_path(spark, sf):
    return weight.line_path(weight.moving_average(fx.weights(spark, sf)), "trendKg").select("owner_id", "path")


@query
def weight_current_trend(spark, sf):
    return weight.current_trend(fx.weights(spark, sf)).select("owner_id", _r("trendKg"))


@query
def weight_history(spark, sf):
    """Each owner's weigh-ins in their order."""
    place = F.row_number().over(Window.partitionBy("owner_id").orderBy(*store.ORDER["weightEntries"]))
    return fx.weights(spark, sf).select("owner_id", place.alias("position"), "id", "date", _r("kg"))


@query
def recent_foods(spark, sf):
    return catalog.recent_foods(fx.diary(spark, sf), fx.foods(spark, sf))


@query
def frequent_foods(spark, sf):
    return catalog.frequent_foods(fx.diary(spark, sf), fx.foods(spark, sf))


@query
def food_suggestions(spark, sf):
    return catalog.suggestions(fx.diary(spark, sf), fx.foods(spark, sf))


@query
def food_search(spark, sf):
    return catalog.search(fx.foods(spark, sf), " Ring ").unionByName(catalog.search(fx.foods(spark, sf), "7890000000012")).select("id", "name")


@query
def food_scan(spark, sf):
    return fx.foods(spark, sf).orderBy("name", "id").select("id", "name")


def _codes(spark, sf):
    """Scanned codes: all that are known, deleted ones too, and an unknown one."""
    return fx.all_foods(spark, sf).select("barcode").union(spark.createDataFrame([("0",)], "barcode string"))


@query
def food_by_id(spark, sf):
    """The foods that diaries name and that are still there."""
    named = fx.diary(spark, sf).where("foodId is not null").select(F.col("foodId").alias("id")).distinct()
    return catalog.by_id(fx.foods(spark, sf), named, "id").select("id", "name")


@query
def settings_by_key(spark, sf):
    """The settings of owners with entries."""
    wanted = fx.diary(spark, sf).select("owner_id", F.lit("settings").alias("id")).distinct()
    return catalog.by_id(fx.settings(spark, sf), wanted, "owner_id", "id").select("owner_id", _r("dailyCalorieTarget", "daily"))


@query
def log_search(spark, sf):
    diary, foods = fx.diary(spark, sf), fx.foods(spark, sf)
    return catalog.log_search("  ", diary, foods).unionByName(catalog.log_search(" rING", diary, foods))


@query
def log_guards(spark, sf):
    """Events whose typed amounts are numbers."""
    e = F.col("event_id")
    typed = fx.table(spark, sf, "events").withColumn("typed", F.when(e % 3 == 0, F.concat(e.cast("string"), F.lit(",5"))).when(e % 3 == 1, "x"))
    return forms.given(typed, "typed", "amount").select("event_id", _r("amount"))


@query
def barcode_lookup(spark, sf):
    return catalog.by_barcode(fx.foods(spark, sf), _codes(spark, sf))


@query
def barcode_resolution(spark, sf):
    return catalog.resolve_barcodes(_codes(spark, sf), fx.foods(spark, sf), products.normalize(fx.products(spark, sf)))


@query
def bmr_tdee(spark, sf):
    out = fx.settings(spark, sf).select("owner_id", energy.energy(F.col("profile"), fx.as_of()).alias("e"))
    return out.select("owner_id", _r("e.bmr", "bmr"), _r("e.tdee", "tdee"), "e.reason")


@query
def parse_decimal(spark, sf):
    text = F.concat(F.when(F.col("p_partkey") % 5 == 0, "1.").otherwise(" "), F.col("p_size").cast("string"), F.when(F.col("p_partkey") % 3 == 0, ",5 ").when(F.col("p_partkey") % 3 == 1, "x").otherwise("e1"))
    return fx.table(spark, sf, "part").select("p_partkey", _r(numbers.parse_decimal(text), "parsed"), _r(numbers.product_number(text), "product"))


@query
def display_rounding(spark, sf):
    value = (F.col("p_partkey") - 100) / 8
    return fx.table(spark, sf, "part").select("p_partkey", numbers.round_display(value, 1).alias("one"), numbers.round_display(value, 2).alias("two"))


@query
def format_number(spark, sf):
    value = F.when(F.col("p_partkey") % 10 != 0, F.col("p_retailprice") * 10)
    return fx.table(spark, sf, "part").select("p_partkey", numbers.format_decimal(value, "pt-BR", 2).alias("pt"), numbers.format_decimal(value, "en-US", 0).alias("en"))


@query
def calendar_weeks(spark, sf):
    date, start = F.to_date("ts"), (F.col("user_id") % 7).cast("int")
    rows = fx.table(spark, sf, "events").select("event_id", dates.iso_date(F.col("ts").cast("timestamp")).alias("date"), start.alias("starts_on"))
    week = dates.start_of_week(F.col("date"), F.col("starts_on"))
    return rows.select(
        "event_id", week.alias("week_start"), dates.end_of_week(F.col("date"), F.col("starts_on")).alias("week_end"),
        dates.days_remaining(F.col("date"), F.col("starts_on")).alias("days_left"), dates.in_range(F.col("date"), week, F.date_add(week, 2)).alias("early"),
    )


@query
def ages(spark, sf):
    return fx.settings(spark, sf).select("owner_id", dates.age_on(F.col("profile.birthDate"), fx.as_of()).alias("age"))


@query
def label_text_parse(spark, sf):
    parsed = labels.parse_labels(fx.labels(spark, sf))
    unit = F.get("servingUnits", F.lit(0))
    return parsed.select(
        "label_id", F.col("nutritionBasis.type").alias("basis"), _r("nutritionBasis.grams", "basis_g"), _r("nutritionBasis.ml", "basis_ml"),
        *[_r(f"nutrition.{n}", n) for n in NUTRIENTS], unit["singular"].alias("singular"), unit["plural"].alias("plural"), _r(unit["quantity"], "quantity"),
        _r(unit["grams"], "unit_g"), _r(unit["ml"], "unit_ml"), F.array_join("warnings", "|").alias("warnings"), "confidence",
    )


@query
def label_food_drafts(spark, sf):
    drafts = labels.food_drafts(labels.parse_labels(fx.labels(spark, sf)), F.concat(F.lit("Produto "), F.col("label_id").cast("string")))
    said = lambda key: F.get_json_object("sourceMetadata", f"$.{key}").alias(key)
    return drafts.select(
        "source", "name", F.col("nutritionBasis.type").alias("basis"), _r("nutritionBasis.grams", "basis_g"), _r("nutritionBasis.ml", "basis_ml"), *_nutrients("nutrition."),
        F.size("servingUnits").alias("units"), said("confidence"), said("rawText"),
    )


@query
def product_json_normalize(spark, sf):
    out = products.normalize(fx.products(spark, sf))
    return out.select("name", "brand", "barcode", _r("nutritionBasis.grams", "basis_g"), *_nutrients("nutrition."), "source")


@query
def product_paths(spark, sf):
    return fx.products(spark, sf).select("barcode", products.lookup_path(F.concat("barcode", F.lit(" é/+"))).alias("path"))


@query
def product_failures(spark, sf):
    """Responses that failed, and foods of those that didn't."""
    n = F.substring("barcode", -1, 1).cast("int")
    rows = fx.products(spark, sf).select("barcode", F.concat(F.lit('{"status": 1, "product": '), "json", F.lit("}")).alias("response"), (F.lit(200) + n * 50).alias("http_status"))
    good = products.from_responses(rows).select("barcode", F.lit(None).cast("string").alias("error"))
    return good.unionByName(products.failed_responses(rows))


@query
def product_responses(spark, sf):
    rows = fx.products(spark, sf).withColumn("_n", F.substring("barcode", -1, 1))
    response = F.concat(F.lit('{"status": '), F.when(F.col("_n") == "3", "0").otherwise("1"), F.lit(', "product": '), F.when(F.col("_n") == "5", "null").otherwise(F.col("json")), F.lit("}"))
    return products.from_responses(rows.select("barcode", response.alias("response"))).select("barcode", "name", _r("nutrition.kcal", "kcal"))


def _food_changes(spark, sf):
    """Two changes to every seventh food and one new food for every hundredth."""
    base = fx.foods(spark, sf).where(F.col("id").try_cast("long") % 7 == 0)
    first = base.withColumn("name", F.concat(F.lit("a "), "name")).withColumn("_seq", F.lit(1))
    second = base.where(F.col("id").try_cast("long") % 2 == 0).withColumn("name", F.concat(F.lit("b "), "name")).withColumn("_seq", F.lit(2))
    new = base.where(F.col("id").try_cast("long") % 100 == 0).withColumn("id", F.concat(F.lit("new"), "id")).withColumn("barcode", F.lit(None).cast("string")).withColumn("_seq", F.lit(1))
    return first.unionByName(second).unionByName(new.withColumn("createdAt", F.lit(None).cast("timestamp")))


@query
def upsert_foods(spark, sf):
    now = F.lit("2024-01-24").cast("timestamp")
    out = store.save_foods(fx.foods(spark, sf), _food_changes(spark, sf), now, "_seq")
    return out.select("id", "name", F.to_date("createdAt").alias("created"), F.to_date("updatedAt").alias("updated"))


@query
def delete_foods(spark, sf):
    doomed = fx.foods(spark, sf).where(F.col("name").startswith("red")).select("id")
    return store.delete(fx.foods(spark, sf), doomed, ("id",)).select("id", "name")


@query
def barcode_conflicts(spark, sf):
    twins = fx.foods(spark, sf).where(F.col("id").try_cast("long") % 50 == 0).withColumn("id", F.concat(F.lit("twin"), "id"))
    return store.barcode_conflicts(fx.foods(spark, sf).unionByName(twins))


@query
def weight_sync_profile(spark, sf):
    changes = fx.weights(spark, sf).where((F.col("id").try_cast("long") % 3 == 0)).withColumn("kg", F.col("kg") + 1)
    _, synced = store.save_weights(fx.weights(spark, sf), fx.settings(spark, sf), changes, fx.as_of(), fx.as_of().cast("timestamp"))
    return synced.select("owner_id", _r("profile.currentWeightKg", "kg"), F.to_date("updatedAt").alias("updated"))


@query
def upsert_weights(spark, sf):
    changes = fx.weights(spark, sf).where((F.col("id").try_cast("long") % 3 == 0)).withColumn("kg", F.col("kg") + 1)
    twice = changes.withColumn("_seq", F.lit(2)).unionByName(changes.withColumns({"kg": F.lit(999.0), "_seq": F.lit(1)}))
    saved, _ = store.save_weights(fx.weights(spark, sf), fx.settings(spark, sf), twice, fx.as_of(), fx.as_of().cast("timestamp"), "_seq")
    return saved.select("owner_id", "id", "date", _r("kg"))


@query
def settings_derived(spark, sf):
    k = F.col("owner_id")
    typed = fx.settings(spark, sf).withColumns({"dailyInput": F.concat(k.cast("string"), F.lit(",5")), "weeklyInput": F.when(k % 2 == 0, "14.000,5").otherwise("9000"), "mealsInput": F.lit("A\n\nB\n")})
    return forms.derive_settings(typed).select("owner_id", _r("dailyCalorieTarget", "daily"), _r("weeklyCalorieTarget", "weekly"), _r("macroTargets.kcal", "macro_kcal"), F.array_join("mealNames", "|").alias("meals"))


@query
def save_settings(spark, sf):
    """Every third owner changes the target twice."""
    base = fx.settings(spark, sf).where("owner_id % 3 = 0")
    changes = base.withColumns({"dailyCalorieTarget": F.lit(1.0), "_seq": F.lit(1)}).unionByName(base.withColumns({"dailyCalorieTarget": F.lit(2.0), "_seq": F.lit(2)}))
    out = store.save_settings(fx.settings(spark, sf), changes, fx.as_of().cast("timestamp"), "_seq")
    return out.select("owner_id", _r("dailyCalorieTarget", "daily"), F.to_date("updatedAt").alias("updated"))


@query
def store_append(spark, sf):
    """A store's diary, written whole up to today and appended to for what comes then."""
    diary = fx.diary(spark, sf)
    kept = store.Store(spark, shared_folder(spark, "store"))
    kept.replace(diaryEntries=diary.where(F.col("date") < fx.as_of()))
    kept.append("diaryEntries", diary.where(F.col("date") >= fx.as_of()))
    return kept.read("diaryEntries").select("owner_id", "id", "date", "meal", "foodName", *_nutrients("nutritionSnapshot."))


@query
def settings_defaults(spark, sf):
    have = fx.settings(spark, sf).where("owner_id % 2 = 0")
    out = store.with_defaults(have, fx.owners(spark, sf), F.lit("2024-01-24").cast("timestamp"))
    return out.select("owner_id", "weekStartsOn", _r("dailyCalorieTarget", "daily"), F.size("mealNames").alias("meals"), F.size("reminders").alias("reminders"), F.col("profile.activityLevel").alias("level"))


@query
def food_forms(spark, sf):
    k = F.col("p_partkey")
    unit = F.struct(F.when(k % 7 != 0, "u").otherwise("").alias("id"), F.when(k % 3 == 0, " fatia ").otherwise("").alias("singular"), F.lit("").alias("plural"), F.when(k % 5 == 0, "").otherwise("2,5").alias("quantity"), F.lit("30").alias("grams"), F.lit("20").alias("ml"))
    typed = fx.table(spark, sf, "part").select(
        k.cast("string").alias("id"), F.when(k % 11 == 0, "  ").otherwise(F.concat(F.lit(" "), "p_name")).alias("name"), F.lit(" ").alias("brand"), F.lit(None).cast("string").alias("barcode"),
        F.when(k % 4 == 3, "volume").otherwise("mass").alias("basisType"), F.when(k % 13 == 0, "x").otherwise("100").alias("basisAmount"),
        F.create_map(F.lit("kcal"), F.concat(F.col("p_size").cast("string"), F.lit(",25")), F.lit("fatG"), F.lit("")).alias("nutrients"), F.array(unit).alias("servingUnits"),
        F.when(k % 2 == 0, "label-ocr").alias("source"), F.when(k % 2 == 0, "{}").alias("sourceMetadata"), F.when(k % 2 == 1, F.lit("2023-12-01").cast("timestamp")).alias("createdAt"),
    )
    unit = F.get("servingUnits", F.lit(0))
    out = forms.clean_foods(typed, fx.as_of().cast("timestamp"))
    return out.select("source", "sourceMetadata", F.to_date("createdAt").alias("created"), F.to_date("updatedAt").alias("updated"), F.length(unit["id"]).alias("unit_id"), "id", "name", "brand", _r("nutritionBasis.grams", "basis_g"), _r("nutritionBasis.ml", "basis_ml"), _r("nutrition.kcal", "kcal"), _r("nutrition.fatG", "fatG"), unit["singular"].alias("singular"), unit["plural"].alias("plural"), _r(unit["grams"], "unit_g"), _r(unit["ml"], "unit_ml"), "error")


@query
def food_prefill(spark, sf):
    existing = fx.foods(spark, sf).select("id", F.when(F.col("id").try_cast("long") % 2 == 0, F.col("name")).alias("name"), "brand", "barcode", "nutritionBasis", "nutrition", "servingUnits", "source", "sourceMetadata", "createdAt")
    drafts = products.normalize(fx.products(spark, sf)).withColumn("id", F.regexp_replace(F.substring("barcode", 4, 10), "^0+(?=[0-9])", ""))
    return forms.prefill(existing, drafts).select("id", "name", "barcode", _r("nutritionBasis.grams", "basis_g"), *_nutrients("nutrition."), "source", F.get_json_object("sourceMetadata", "$.provider").alias("provider"))


def _documents(spark, sf):
    diary = fx.diary(spark, sf)
    eaten = diary.where(F.col("foodId").isNotNull()).select("owner_id", F.col("foodId").alias("id")).distinct()
    mine = eaten.join(fx.foods(spark, sf), "id").select("owner_id", *[F.col(c) for c in fx.foods(spark, sf).columns])
    return backup.build(fx.settings(spark, sf), mine, diary, fx.weights(spark, sf), F.lit("2024-01-24T00:00:00Z"))


@query
def backup_roundtrip(spark, sf):
    """Documents of all owners, read again: rows and totals of each table by owner."""
    tables = backup.read(backup.validate(_documents(spark, sf)).where("error is null"))
    diary = tables["diaryEntries"].groupBy("owner_id").agg(F.count("*").alias("entries"), F.sum("nutritionSnapshot.kcal").alias("kcal"))
    weights = tables["weightEntries"].groupBy("owner_id").agg(F.count("*").alias("weights"), F.sum("kg").alias("kg"))
    foods = tables["foods"].groupBy("owner_id").agg(F.count("*").alias("foods"))
    out = tables["settings"].join(diary, "owner_id", "left").join(weights, "owner_id", "left").join(foods, "owner_id", "left")
    return out.select("owner_id", _r("dailyCalorieTarget", "daily"), F.coalesce("entries", F.lit(0)).alias("entries"), _r("kcal"), F.coalesce("weights", F.lit(0)).alias("weights"), _r("kg"), F.coalesce("foods", F.lit(0)).alias("foods"))


@query
def backup_entries(spark, sf):
    """The diary as it's read again from documents."""
    diary = backup.read(_documents(spark, sf))["diaryEntries"]
    return diary.select("owner_id", "id", "date", "meal", "foodId", "foodName", _r("amount"), "unitId", "unitLabel", _r("grams"), _r("ml"), *_nutrients("nutritionSnapshot."), F.to_date("createdAt").alias("created"))


@query
def backup_validation(spark, sf):
    """Each check fails for some owners."""
    documents = F.element_at(F.array(*[F.lit(c) for c in backup_cases()]), (F.col("owner_id") % len(backup_cases()) + 1).cast("int"))
    return backup.validate(fx.owners(spark, sf).select("owner_id", documents.alias("backup"))).select("owner_id", "error")


@query
def streaming_daily_totals(spark, sf):
    """Extension: daily energy of quick calories, as a stream over the events."""
    return daily.quick_totals(spark, sf)


# ------------------------------------------------- the store and what it keeps


def _store(spark) -> store.Store:
    return store.Store(spark, shared_folder(spark, "store"))


def _refused(*attempts: Callable[[], None]) -> int:
    """How many of the changes are refused."""
    out = 0
    for attempt in attempts:
        try:
            attempt()
        except ValueError:
            out += 1
    return out


@query
def store_unique_barcodes(spark, sf):
    """Foods that are written in parts; a known barcode under another id is refused however it comes."""
    kept, foods, k = _store(spark), fx.foods(spark, sf), F.col("id").try_cast("long")
    kept.replace(foods=foods.where(k % 2 == 0))
    kept.append("foods", foods.where(k % 2 == 1))
    twins = foods.where(k % 50 == 0).withColumn("id", F.concat(F.lit("twin"), "id"))
    taken = foods.where(k % 50 == 1).withColumn("barcode", F.concat(F.lit("789"), F.lpad((k - 1).cast("string"), 10, "0")))
    refused = _refused(lambda: kept.append("foods", twins), lambda: kept.upsert("foods", twins), lambda: kept.upsert("foods", taken), lambda: kept.replace(foods=foods.unionByName(twins)))
    return kept.read("foods").select("id", "barcode", F.lit(refused).alias("refused"))


@query
def store_upsert(spark, sf):
    """Foods changed and added through a store."""
    kept = _store(spark)
    kept.replace(foods=fx.foods(spark, sf))
    kept.save_foods(_food_changes(spark, sf), F.lit("2024-01-24").cast("timestamp"), "_seq")
    return kept.read("foods").select("id", "name", F.to_date("createdAt").alias("created"), F.to_date("updatedAt").alias("updated"))


@query
def store_delete(spark, sf):
    kept = _store(spark)
    kept.replace(foods=fx.foods(spark, sf))
    kept.delete("foods", fx.foods(spark, sf).where(F.col("name").startswith("red")).select("id"))
    return kept.read("foods").select("id", "name")


@query
def store_lookup(spark, sf):
    """Some foods by id and some by barcode, by way of buckets, bounds and filters."""
    kept, codes = _store(spark), [f"789{k:010d}" for k in range(12, 130, 13)]
    kept.replace(foods=fx.foods(spark, sf))
    by_id = kept.lookup("foods", "id", [str(k) for k in range(5, 140, 14)])
    return by_id.select(F.lit("id").alias("by"), "id", "name").unionByName(kept.lookup("foods", "barcode", codes).select(F.lit("barcode").alias("by"), "id", "name"))


@query
def store_daily_sums(spark, sf):
    """The sums that a store keeps of its diary, after entries were added, changed and deleted."""
    diary, kept, k = fx.diary(spark, sf), _store(spark), F.col("id").try_cast("long")
    kept.replace(diaryEntries=diary.where(F.col("date") < fx.as_of()))
    kept.append("diaryEntries", diary.where(F.col("date") >= fx.as_of()))
    twice = F.col("nutritionSnapshot").withField("kcal", F.col("nutritionSnapshot.kcal") * 2)
    kept.upsert("diaryEntries", diary.where(k % 5 == 0).withColumn("nutritionSnapshot", twice))
    kept.delete("diaryEntries", diary.where(k % 7 == 0))
    return kept.daily_sums().select("owner_id", "date", "entries", *[_exact(n) for n in NUTRIENTS])


@query
def store_weekly_summary(spark, sf):
    """The flagship from the sums that a store keeps; its diary isn't read."""
    kept, diary = _store(spark), fx.diary(spark, sf)
    kept.replace(diaryEntries=diary.where(F.col("date") < fx.as_of()))
    kept.append("diaryEntries", diary.where(F.col("date") >= fx.as_of()))
    out = budget.weekly_summary_of_days(kept.daily_sums(), fx.settings(spark, sf), fx.as_of())
    return out.select("owner_id", "week_start", "week_end", _exact("target"), _exact("consumed"), _exact("remaining"), "remaining_days")


def _faulty_foods(spark, sf):
    """Foods of which some have no id, and some numbers that aren't finite."""
    k, nan = F.col("id").try_cast("long"), F.lit(float("nan"))
    infinite = F.transform("servingUnits", lambda u: u.withField("quantity", F.lit(float("inf"))))
    return fx.foods(spark, sf).withColumns({
        "nutrition": F.when(k % 10 == 3, F.col("nutrition").withField("fatG", nan)).otherwise(F.col("nutrition")),
        "servingUnits": F.when(k % 20 == 6, infinite).otherwise(F.col("servingUnits")), "id": F.when(k % 10 != 4, F.col("id")),
    })


@query
def store_guards(spark, sf):
    """What is stored of rows of which some can't be; all of them are refused unless told otherwise."""
    kept, rows = _store(spark), _faulty_foods(spark, sf)
    refused = _refused(lambda: kept.append("foods", rows), lambda: kept.replace(foods=rows))
    kept.append("foods", rows, rejects="drop")
    return kept.read("foods").select("id", "name", F.lit(refused).alias("refused"))


@query
def guard_reasons(spark, sf):
    found = guards.rejected("foods", _faulty_foods(spark, sf)).select("barcode", F.explode("reasons").alias("reason"))
    return found.groupBy("reason").agg(F.count("*").alias("n"))


@query
def store_stream(spark, sf):
    """Quick calories of the events, streamed into a store; the last batch comes again and adds nothing."""
    e, kept = F.col("event_id"), _store(spark)
    lines = daily.events(spark, sf).where("event_type <> 'signup' and event_id % 11 = 0").select(
        e.cast("string").alias("id"), F.col("user_id").alias("owner_id"), F.to_date("ts").alias("date"), F.col("event_type").alias("meal"), F.lit(None).cast("string").alias("foodId"),
        F.col("value").alias("amount"), F.lit("kcal").alias("unitId"), F.col("ts").cast("timestamp").alias("createdAt"),
    )
    daily.into_store(portions.quick_calories(lines), kept, "diaryEntries", "quick", shared_folder(spark, "stream"))
    if stored := kept.log.latest()[1]["batches"]:
        kept.sink("diaryEntries", "quick")(portions.quick_calories(fx.intake(spark, sf)), stored["quick"])
    return kept.read("diaryEntries").select("owner_id", "id", "date", "meal", "foodName", _r("nutritionSnapshot.kcal", "kcal"))


@query
def store_erase(spark, sf):
    """An emptied store: default settings, and nothing in the other tables."""
    kept = _store(spark)
    kept.replace(foods=fx.foods(spark, sf), settings=fx.settings(spark, sf), weightEntries=fx.weights(spark, sf))
    kept.erase(fx.owners(spark, sf), fx.as_of().cast("timestamp"))
    left = sum(kept.read(n).count() for n in ("foods", "weightEntries", "diaryEntries")) + kept.daily_sums().count()
    return kept.read("settings").select("owner_id", _r("dailyCalorieTarget", "daily"), F.to_date("updatedAt").alias("updated"), F.lit(left).alias("left"))


# ------------------------------------------------------- lookups, joins, guards


def _index(spark, sf):
    path = shared_folder(spark, "grams")
    search.write_index(fx.foods(spark, sf), path)
    return spark.read.parquet(path)


@query
def food_search_indexed(spark, sf):
    """Long and short needles, one that nothing holds, and letters that are wildcards elsewhere."""
    foods, grams = fx.foods(spark, sf), _index(spark, sf)
    found = [search.search(foods, grams, n).select(F.lit(n).alias("needle"), "id") for n in (" Ring ", "7890000000012", "e", "ED", "#1", "zzz", "%", "_")]
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


@query
def food_search_many(spark, sf):
    """Every brand, and how names begin, searched at once."""
    parts = fx.table(spark, sf, "part")
    needles = parts.select(F.upper("p_brand").alias("needle")).union(parts.select(F.left("p_name", F.lit(2)))).union(parts.select(F.left("p_name", F.lit(1)))).distinct()
    return search.search_many(fx.foods(spark, sf), _index(spark, sf), needles).select("needle", "id")


@query
def weight_known_daily(spark, sf):
    """Each day of a diary with the weight then known."""
    days = fx.diary(spark, sf).select("owner_id", "date").distinct()
    return weight.known_on(days, fx.weights(spark, sf)).select("owner_id", "date", _r("kg"))


@query
def hot_food_join(spark, sf):
    """Lines of which half name one food, joined with the foods."""
    lines = fx.intake(spark, sf).select("id", F.when(F.col("id").try_cast("long") % 2 == 0, "1").otherwise(F.col("foodId")).alias("foodId"))
    return skew.salted_join(lines, fx.all_foods(spark, sf).select(F.col("id").alias("foodId"), "name"), "foodId", "left").select("id", "foodId", "name")


@query
def portion_resolution_salted(spark, sf):
    """As ``portion_resolution``, by the join for foods that many lines name."""
    done = portions.resolve(fx.intake(spark, sf), fx.foods(spark, sf), salted=True)
    return done.select("id", "foodId", "unitId", _r("portion.grams", "grams"), _r("portion.ml", "ml"), "portion.label", *_nutrients("portion.nutrition."), "portion.error")


@query
def loggable_lines(spark, sf):
    """Lines whose food is there and whose typed amount is a number."""
    k = F.col("id").try_cast("long")
    typed = fx.intake(spark, sf).select("id", "foodId", F.when(k % 3 == 0, F.concat("id", F.lit(",5"))).when(k % 3 == 1, " x").alias("typed"))
    return forms.loggable(typed, fx.foods(spark, sf)).select("id", "foodId", _r("amount"))


@query
def required_decimals(spark, sf):
    """Numbers that must be given; all of these are."""
    text = F.concat(F.lit(" "), F.col("event_id").cast("string"), F.lit(",5 "))
    return fx.table(spark, sf, "events").select("event_id", _r(numbers.required_decimal(text, "amount"), "amount"))


# ------------------------------------------------------------------- backups


@query
def backup_restore(spark, sf):
    """Documents whose copies of a food differ, restored: the last owner's counts."""
    diary = fx.diary(spark, sf)
    eaten = diary.where(F.col("foodId").isNotNull()).select("owner_id", F.col("foodId").alias("id")).distinct()
    mine = eaten.join(fx.foods(spark, sf), "id").withColumn("name", F.concat("name", F.lit(" of "), F.col("owner_id").cast("string")))
    documents = backup.build(fx.settings(spark, sf), mine.select("owner_id", *fx.foods(spark, sf).columns), diary, fx.weights(spark, sf), F.lit("2024-01-24T00:00:00Z"))
    kept = _store(spark)
    backup.restore(kept, written(backup.validate(documents), "documents"))
    return kept.read("foods").select("id", "name", "barcode")


@query
def backup_rejected_values(spark, sf):
    """Documents that pass the checks and hold some values of other types."""
    k = F.col("owner_id")
    pick = lambda n, bad, good: F.when(k % n == 0, bad).otherwise(good)
    document = F.concat(
        F.lit('{"version":1,"settings":{"id":"settings","dailyCalorieTarget":'), pick(11, "true", "2000"), F.lit('},"foods":[{"id":"f","name":"x","nutritionBasis":{"type":"mass"},"nutrition":{"kcal":1},"servingUnits":[{"id":"u"},{"id":"v","grams":'),
        pick(13, '"3"', "3"), F.lit('}]}],"diaryEntries":[{"id":"a","date":"2024-01-02"},{"id":"b","date":'), pick(5, '"someday"', '"2024-01-01"'), F.lit(',"grams":'), pick(2, '"abc"', "5"),
        F.lit(',"nutritionSnapshot":{"kcal":'), pick(3, '"7"', "null"), F.lit('}}],"weightEntries":[{"id":"w","date":"2024-01-01","kg":'), pick(7, "{}", "70.5"), F.lit("}]}"),
    )
    good = backup.validate(fx.owners(spark, sf).select("owner_id", document.alias("backup"))).where("error is null")
    return backup.rejected_values(good)


@query
def backup_fragment_entries(spark, sf):
    """The diary as it's read again from the pieces of documents."""
    diary = fx.diary(spark, sf)
    eaten = diary.where(F.col("foodId").isNotNull()).select("owner_id", F.col("foodId").alias("id")).distinct()
    mine = eaten.join(fx.foods(spark, sf), "id").select("owner_id", *fx.foods(spark, sf).columns)
    pieces = written(backup.fragments(fx.settings(spark, sf), mine, diary, fx.weights(spark, sf), F.lit("2024-01-24T00:00:00Z")), "fragments")
    diary = backup.read_fragments(pieces)["diaryEntries"]
    return diary.select("owner_id", "id", "date", "meal", "foodId", "foodName", _r("amount"), "unitId", _r("grams"), _r("ml"), "unitLabel", *_nutrients("nutritionSnapshot."), F.to_date("createdAt").alias("created"))


@query
def backup_repeated_ids(spark, sf):
    """Documents that hold each entry twice: the last one stays."""
    diary = fx.diary(spark, sf)
    again = diary.unionByName(diary.withColumn("amount", F.col("amount") + 1))
    documents = backup.build(fx.settings(spark, sf), fx.foods(spark, sf).limit(0).withColumn("owner_id", F.lit(0).cast("long")), again, fx.weights(spark, sf), F.lit("2024-01-24T00:00:00Z"))
    return backup.read(documents)["diaryEntries"].select("owner_id", "id", _r("amount"))


@query
def backup_names(spark, sf):
    """What each owner's exported document is called."""
    empty = fx.foods(spark, sf).limit(0).withColumn("owner_id", F.lit(0).cast("long"))
    documents = backup.build(fx.settings(spark, sf), empty, fx.diary(spark, sf).limit(0), fx.weights(spark, sf), F.lit("2024-01-24T08:09:10Z"))
    return documents.select("owner_id", backup.file_name(F.col("backup")).alias("name"))


@query
def backup_files(spark, sf):
    """Weigh-ins written as a file for each owner, and read again."""
    settings = fx.settings(spark, sf)
    none = fx.diary(spark, sf).limit(0)
    documents = backup.build(settings, fx.foods(spark, sf).limit(0).withColumn("owner_id", F.lit(0).cast("long")), none, fx.weights(spark, sf), F.lit("2024-01-24T00:00:00Z"), pretty=True)
    path = shared_folder(spark, "files")
    backup.export_files(documents, path)
    weights = backup.read(backup.import_files(spark, path).where("error is null"))["weightEntries"]
    return weights.select("owner_id", "id", "date", _r("kg"))
