import datetime as dt

import pytest
from pyspark.sql import functions as F

from victual.operators import catalog, forms, products
from victual.plans.queries import QUERIES
from victual.schemas import NUTRIENTS, schema
from victual.sources import backup
from victual.sources.store import Store, default_settings, save_foods, save_settings, save_weights, with_defaults
from tests.test_golden import food, settings, weights


CREAM_KEYS = NUTRIENTS


def now():
    return F.lit("2026-08-20").cast("timestamp")


def test_versions_replace_and_constraints(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    assert store.read("foods").count() == 0 and store.version() == 0
    store.replace(foods=food(spark, barcode="1"))
    store.replace(foods=save_foods(store.read("foods"), food(spark, id="g", name="A", barcode="2"), now()))
    assert [r.id for r in store.read("foods", ordered=True).collect()] == ["g", "f"] and store.version() == 2
    with pytest.raises(ValueError, match="barcode 1"):
        store.replace(foods=save_foods(store.read("foods"), food(spark, id="h", barcode="1"), now()))
    assert store.version() == 2
    store.replace(foods=save_foods(store.read("foods"), food(spark, id="h").unionByName(food(spark, id="i")), now()))
    store.erase(spark.createDataFrame([(1,)], "owner_id long"), now())
    assert store.read("foods").count() == 0 and store.read("settings").first().dailyCalorieTarget == 2000


def test_logging_is_insert_only(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    row = spark.createDataFrame([(1, "e", dt.date(2026, 8, 20), "Lunch", None, "x", 1.0, "kcal", "kcal", None, None, None, None)], schema("diaryEntries"))
    store.log_foods(row)
    with pytest.raises(ValueError, match="diaryEntries e exists"):
        store.log_foods(row)


def test_appending_writes_new_rows_only(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    store.replace(foods=food(spark), diaryEntries=spark.createDataFrame([(1, "a", dt.date(2026, 8, 20), "Lunch", None, "x", 1.0, "kcal", "kcal", None, None, None, None)], schema("diaryEntries")))
    before = {p.name for p in (tmp_path / "store" / "data").iterdir()}
    more = spark.createDataFrame([(1, i, dt.date(2026, 8, 1), "Lunch", None, "y", 2.0, "kcal", "kcal", None, None, None, None) for i in ("c", "b")], schema("diaryEntries"))
    store.append("diaryEntries", more)
    assert len({p.name for p in (tmp_path / "store" / "data").iterdir()} - before) == 1 and store.version() == 2
    assert [r.id for r in store.read("diaryEntries", ordered=True).collect()] == ["b", "c", "a"] and store.read("foods").count() == 1
    with pytest.raises(ValueError, match="diaryEntries d exists"):
        store.append("diaryEntries", more.withColumn("id", F.lit("d")))


def test_scans_are_ordered(spark):
    sf = "/root/testdata/sf0.001"
    rows = QUERIES["food_scan"](spark, sf).collect()
    assert [(r.name, r.id) for r in rows] == sorted((r.name, r.id) for r in rows)
    rows = QUERIES["diary_scan"](spark, sf).collect()
    assert [(r.owner_id, r.id) for r in rows] == [(r.owner_id, r.id) for r in sorted(sorted(rows, key=lambda r: r.id, reverse=True), key=lambda r: r.owner_id)]


def test_of_two_changes_one_stays(spark):
    twice = food(spark, name="first").withColumn("_seq", F.lit(1)).unionByName(food(spark, name="last").withColumn("_seq", F.lit(2)))
    assert [r.name for r in save_foods(food(spark), twice, now(), "_seq").collect()] == ["last"]
    assert [r.name for r in save_foods(food(spark), twice.drop("_seq"), now()).collect()] == ["last"]  # the greatest row
    changes = weights(spark, ("2026-08-20", 80)).withColumn("_seq", F.lit(1)).unionByName(weights(spark, ("2026-08-20", 70)).withColumn("_seq", F.lit(2)))
    saved, synced = save_weights(weights(spark, ("2026-08-01", 83)), settings(spark), changes, F.lit("2026-08-20").cast("date"), now(), "_seq")
    assert [r.kg for r in saved.collect()] == [70] and synced.first().profile.currentWeightKg == 70


def test_settings_are_stamped(spark):
    today = F.lit("2026-08-20").cast("date")
    out = save_settings(settings(spark), settings(spark, dailyCalorieTarget=1.0), now()).first()
    assert (out.dailyCalorieTarget, out.updatedAt) == (1.0, dt.datetime(2026, 8, 20))
    for date, stamp in (("2026-08-20", dt.datetime(2026, 8, 20)), ("2026-08-19", dt.datetime(2026, 8, 1))):
        _, synced = save_weights(weights(spark), settings(spark), weights(spark, (date, 80)), today, now())
        assert synced.first().updatedAt == stamp


def test_weigh_in_of_today_reaches_the_profile(spark):
    today = F.lit("2026-08-20").cast("date")
    for date, expected in (("2026-08-20", 80.0), ("2026-08-19", None)):
        saved, synced = save_weights(weights(spark, ("2026-08-01", 83)), settings(spark), weights(spark, (date, 80)), today, now())
        assert saved.count() == 1 and saved.first().kg == 80 and synced.first().profile.currentWeightKg == expected


def test_defaults_fill_gaps(spark):
    owners = spark.createDataFrame([(1,), (2,)], "owner_id long")
    mine = default_settings(owners.where("owner_id = 1"), now()).withColumn("dailyCalorieTarget", F.lit(1.0))
    assert {r.owner_id: r.dailyCalorieTarget for r in with_defaults(mine, owners, now()).collect()} == {1: 1.0, 2: 2000.0}


def test_search_takes_wildcards_literally(spark):
    foods = food(spark, name="100% Suco").unionByName(food(spark, id="g", brand="Ação"))
    found = lambda needle: {r.id for r in catalog.search(foods, needle).collect()}
    assert found("%") == {"f"} and found("_") == set() and found("  ") == {"f", "g"} and found("AÇÃO") == {"g"} and found("cream") == {"g"}


def test_limits_come_before_the_join(spark):
    rows = [(1, str(i), dt.date(2026, 8, 1 + i), f"f{i % 10}", dt.datetime(2026, 8, 1 + i)) for i in range(12)] + [(1, "q", dt.date(2026, 8, 20), "", dt.datetime(2026, 8, 20))]
    diary = spark.createDataFrame(rows, "owner_id long, id string, date date, foodId string, createdAt timestamp")
    foods = spark.createDataFrame([(f"f{i}", f"n{i}") for i in range(9)], "id string, name string")
    recent = [(r.rank, r.foodId) for r in catalog.recent_foods(diary, foods).orderBy("rank").collect()]
    assert recent == [(1, "f1"), (2, "f0"), (4, "f8"), (5, "f7"), (6, "f6"), (7, "f5"), (8, "f4")]
    frequent = [r.foodId for r in catalog.frequent_foods(diary, foods).orderBy("rank").collect()]
    assert frequent == ["f0", "f1", "f2", "f3", "f4", "f5", "f6", "f7"]
    assert [r.foodId for r in catalog.suggestions(diary, foods).orderBy("section", "rank").collect()][7:] == ["f2", "f3"]


def test_products(spark):
    rows = [
        ("1", '{"product_name": "", "nutriments": {"energy-kcal_100g": "1,5", "fat_100g": "", "sodium_100g": 0.1, "fiber_100g": "x"}}'),
        ("2", '{"product_name": "P", "brands": "B", "nutriments": {"sodium_mg_100g": "7"}}'),
        ("3", "not json"),
    ]
    one, two, three = products.normalize(spark.createDataFrame(rows, "barcode string, json string")).orderBy("barcode").collect()
    assert (one.name, one.nutrition.kcal, one.nutrition.fatG, one.nutrition.sodiumMg, one.nutrition.fiberG) == ("Produto 1", 1.5, 0.0, 100.0, None)
    assert (two.name, two.brand, two.nutrition.sodiumMg) == ("P", "B", 7.0)
    assert three.name == "Produto 3" and three.nutrition.kcal is None
    path = spark.range(1).select(products.lookup_path(F.lit("a b/1")).alias("p")).first().p
    assert path == "/api/v2/product/a%20b%2F1.json"


def test_export_import_and_restore(spark, tmp_path):
    diary = spark.createDataFrame([(1, "e", dt.date(2026, 8, 20), "Lunch", "f", "Cream", 1.0, "g", "g", 1.0, None, None, None)], schema("diaryEntries"))
    mine = food(spark, name="a\nb").withColumn("owner_id", F.lit(1).cast("long"))
    built = backup.build(settings(spark), mine, diary, weights(spark, ("2026-08-01", 83)), F.lit("2026-08-20"), pretty=True)
    backup.export_files(built, str(tmp_path / "out"))
    read = backup.import_files(spark, str(tmp_path / "out"))
    store = Store(spark, str(tmp_path / "store"))
    backup.restore(store, read)
    assert store.read("foods").first().name == "a\nb" and store.read("diaryEntries").first().date == dt.date(2026, 8, 20)
    assert store.read("weightEntries").first().kg == 83 and store.read("settings").first().weekStartsOn == 1
    broken = spark.createDataFrame([(1, "{}")], "owner_id long, backup string")
    with pytest.raises(ValueError, match="unsupported-version"):
        backup.restore(store, backup.validate(broken))
    assert store.version() == 1


def test_entries_of_one_moment(spark):
    """Recent foods go by the latest entry, and those of one moment by its date and id, not by the food's id."""
    at = dt.datetime(2026, 8, 20)
    rows = [(1, "3", dt.date(2026, 8, 20), "a", at), (1, "2", dt.date(2026, 8, 20), "b", at), (1, "9", dt.date(2026, 8, 19), "c", at), (1, "1", dt.date(2026, 8, 1), "a", dt.datetime(2026, 8, 1))]
    diary = spark.createDataFrame(rows, "owner_id long, id string, date date, foodId string, createdAt timestamp")
    foods = spark.createDataFrame([(f, f) for f in "abc"], "id string, name string")
    assert [r.foodId for r in catalog.recent_foods(diary, foods).orderBy("rank").collect()] == ["c", "b", "a"]


def test_a_draft_keeps_its_provenance(spark):
    """From a label's draft through the form to a saved food; an edited food keeps its own."""
    draft = food(spark, id="new", name="Draft", source="label-ocr", sourceMetadata='{"confidence": "high"}').drop("createdAt", "updatedAt")
    edited = food(spark, createdAt=dt.datetime(2020, 1, 1), nutrition={**{n: None for n in CREAM_KEYS}, "kcal": 5.0})
    filled = forms.prefill(edited, draft.unionByName(draft.withColumn("id", F.lit("f"))))
    typed = filled.select(
        "id", "name", "brand", "barcode", F.col("nutritionBasis.type").alias("basisType"), F.lit("100").alias("basisAmount"), F.create_map(F.lit("kcal"), F.col("nutrition.kcal").cast("string")).alias("nutrients"),
        F.array().cast("array<struct<id:string,singular:string,plural:string,quantity:string,grams:string,ml:string>>").alias("servingUnits"), "source", "sourceMetadata", "createdAt",
    )
    saved = {r.id: r for r in forms.clean_foods(typed, now()).collect()}
    assert (saved["new"].source, saved["new"].sourceMetadata, saved["new"].createdAt) == ("label-ocr", '{"confidence": "high"}', dt.datetime(2026, 8, 20))
    assert (saved["f"].source, saved["f"].createdAt, saved["f"].updatedAt, saved["f"].nutrition.kcal) == ("manual", dt.datetime(2020, 1, 1), dt.datetime(2026, 8, 20), 5.0)


def test_exports_are_dated(spark, tmp_path):
    rows = spark.createDataFrame([(1, '{"exportedAt": "2026-08-20T10:00:00Z"}'), (2, "{}")], "owner_id long, backup string")
    backup.export_files(rows, str(tmp_path / "out"))
    assert {p.parent.name + "/" + p.name for p in (tmp_path / "out").glob("owner_id=*/exported=*")} == {"owner_id=1/exported=2026-08-20", "owner_id=2/exported=undated"}


def test_the_last_row_of_an_id_is_read(spark):
    document = '{"version": 1, "settings": {"id": "settings"}, "foods": [], "diaryEntries": [], "weightEntries": [{"id": "w", "kg": 1}, {"id": "v", "kg": 2}, {"id": "w", "kg": 3}]}'
    tables = backup.read(spark.createDataFrame([(1, document)], "owner_id long, backup string"))
    assert {(r.id, r.kg) for r in tables["weightEntries"].collect()} == {("w", 3.0), ("v", 2.0)}
