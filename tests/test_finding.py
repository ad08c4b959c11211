"""Search by grams, joins with heavy keys, weights as of a day, and backups in pieces, against plain ways."""

import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from victual.operators import catalog, forms, search, skew, weight
from victual.sources import backup, work
from victual.sources.store import Store
from tests.test_golden import food
from tests.test_versions import entries, foods, rows_read

NEEDLES = ("", "  ", "a", "B", "ab", " ABC ", "%", "_", "é", "ção", "É", "x y", "zz", "\0", "0", "10", "aaaa")


def named(spark, seed, n=60):
    draw = random.Random(seed)
    text = lambda: draw.choice([None, "", "".join(draw.choices("aAbBcé ç%_xy0", k=draw.randint(1, 7)))])
    return spark.createDataFrame([(str(i), text(), text(), draw.choice([None, str(i), f"00{i}"])) for i in range(n)], "id string, name string, brand string, barcode string")


def test_search_by_grams_finds_what_a_scan_finds(spark, tmp_path):
    rows = named(spark, 1)
    search.write_index(rows, str(tmp_path / "grams"))
    grams = spark.read.parquet(str(tmp_path / "grams"))
    for needle in NEEDLES:
        want = {r.id for r in catalog.search(rows, needle).collect()}
        assert {r.id for r in search.search(rows, grams, needle).collect()} == want, needle
    many = search.search_many(rows, grams, spark.createDataFrame([(n,) for n in NEEDLES] + [("a",)], "needle string"))
    got = {}
    for r in many.collect():
        assert r.id not in got.setdefault(r.needle, set())
        got[r.needle].add(r.id)
    assert got == {n: found for n in NEEDLES if n.strip() and (found := {r.id for r in catalog.search(rows, n).collect()})}
    assert search.index(rows.limit(0)).count() == 0


def test_a_needle_reads_its_grams_only(spark, tmp_path):
    words = spark.range(20_000).select(F.col("id").cast("string").alias("id"), F.sha2(F.col("id").cast("string"), 256).alias("name"), F.lit(None).cast("string").alias("brand"), F.lit(None).cast("string").alias("barcode"))
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    search.write_index(words, str(tmp_path / "grams"))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    grams = spark.read.parquet(str(tmp_path / "grams"))
    assert rows_read(grams.where(F.col("gram").isin(["abc"]))) < grams.count() / 4


@pytest.mark.parametrize("how", ["inner", "left"])
def test_joins_with_a_heavy_key(spark, how):
    lines = spark.range(3000).select("id", F.when(F.col("id") % 2 == 0, "hot").when(F.col("id") % 7 == 1, F.lit(None)).otherwise((F.col("id") % 50).cast("string")).alias("foodId"))
    right = spark.createDataFrame([("hot", "x"), ("1", "y"), ("3", "z"), ("3", "twice")], "foodId string, name string")
    key = lambda df: sorted(((r.id, r.foodId, r.name) for r in df.collect()), key=repr)
    assert key(skew.salted_join(lines, right, "foodId", how)) == key(lines.join(right, "foodId", how))
    assert "hot" in skew.heavy_keys(lines, "foodId") and skew.heavy_keys(lines.limit(0), "foodId") == []
    assert skew.salted_join(lines.limit(0), right, "foodId", how).count() == 0


def test_no_task_holds_a_heavy_key(spark):
    """Half of the lines name one food; without the sketch half of them meet in one partition."""
    set_ = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "16"}
    before = {k: spark.conf.get(k) for k in set_}
    for k, v in set_.items():
        spark.conf.set(k, v)
    lines = spark.range(20_000).select("id", F.when(F.col("id") % 2 == 0, "hot").otherwise((F.col("id") % 5000).cast("string")).alias("foodId"))
    right = lines.select("foodId").distinct().withColumn("name", F.lit("x"))
    largest = lambda df: df.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
    plain, salted = largest(lines.join(right, "foodId")), largest(skew.salted_join(lines, right, "foodId"))
    for k, v in before.items():
        spark.conf.set(k, v)
    assert plain > 10_000 and salted < 2_500


def test_weights_as_of_days(spark):
    draw = random.Random(3)
    day = lambda: dt.date(2026, 1, 1) + dt.timedelta(draw.randrange(200))
    weights = [(draw.randrange(4), str(i), day(), draw.choice([None, float(60 + i)])) for i in range(60)] + [(9, "1", dt.date(2026, 3, 1), 80.0)]
    days = [(draw.randrange(5), day(), i) for i in range(300)] + [(9, dt.date(2026, 2, 28), 0), (9, dt.date(2026, 3, 1), 1), (9, dt.date(2029, 1, 1), 2), (9, dt.date(2029, 1, 1), 2)]
    got = weight.known_on(spark.createDataFrame(days, "owner_id long, date date, n int"), spark.createDataFrame(weights, "owner_id long, id string, date date, kg double"))

    def known(owner, date):
        past = [(d, i, kg) for o, i, d, kg in weights if o == owner and d <= date and kg is not None]
        return max(past)[2] if past else None

    assert sorted((r.owner_id, r.date, r.n, r.kg or 0) for r in got.collect()) == sorted((o, d, n, known(o, d) or 0) for o, d, n in days)


def test_lines_that_can_be_logged(spark):
    lines = spark.createDataFrame([(1, "f", "1,5"), (2, "gone", "2"), (3, None, "2"), (4, "f", "x"), (5, "f", None)], "n int, foodId string, typed string")
    assert [(r.n, r.amount) for r in forms.loggable(lines, food(spark)).collect()] == [(1, 1.5)]


# ------------------------------------------------------------------- backups


def documents(spark, *rows):
    return backup.validate(spark.createDataFrame([(o, d if isinstance(d, str) else json.dumps(d)) for o, d in rows], "owner_id long, backup string"))


GOOD = {"version": 1, "settings": {"id": "settings"}, "foods": [], "diaryEntries": [], "weightEntries": []}
FOOD = {"id": "3", "name": "x", "nutritionBasis": {"type": "mass", "grams": 100}, "nutrition": {"kcal": 1}}


def test_values_of_another_type_are_reported(spark, tmp_path):
    entry = {"id": "a", "date": "soon", "grams": "abc", "nutritionSnapshot": {"kcal": "7", "fatG": None, "proteinG": 2}}
    wrong = {**GOOD, "foods": [{**FOOD, "servingUnits": [{"id": "u"}, {"id": "v", "ml": [1]}]}], "diaryEntries": [{"id": "ok", "date": "2026-08-01"}, entry], "weightEntries": [5, {"id": "w", "kg": 7}]}
    rows = documents(spark, (1, GOOD), (2, wrong))
    got = sorted((r.owner_id, r.table, r.position, r.id, r.field, r.value) for r in backup.rejected_values(rows).collect())
    assert got == sorted([
        (2, "diaryEntries", 1, "a", "date", '"soon"'), (2, "diaryEntries", 1, "a", "grams", '"abc"'), (2, "diaryEntries", 1, "a", "nutritionSnapshot.kcal", '"7"'),
        (2, "foods", 0, "3", "servingUnits[1].ml", "[1]"), (2, "weightEntries", 0, None, "", "5"),
    ], key=lambda r: (r[0], r[1], r[2], r[3] or "", r[4]))
    store = Store(spark, str(tmp_path))
    with pytest.raises(ValueError, match='backup of 2: diaryEntries 1 has date "soon", and 5 such values'):
        backup.restore(store, rows)
    assert store.version() == 0
    only = documents(spark, (2, {**wrong, "weightEntries": []}))
    assert backup.restore(store, only, rejects="null").count() == 4
    kept = {r.id: r for r in store.read("diaryEntries").collect()}
    assert kept["a"].grams is None and kept["a"].nutritionSnapshot.kcal is None and kept["a"].nutritionSnapshot.proteinG == 2


def test_the_last_copy_of_a_food_is_restored(spark, tmp_path):
    one, two = {**FOOD, "name": "one"}, {**FOOD, "name": "two"}
    rows = documents(spark, (2, {**GOOD, "foods": [two, {**FOOD, "name": "last"}]}), (1, {**GOOD, "foods": [one]}))
    for k in range(2):
        store = Store(spark, str(tmp_path / str(k)))
        backup.restore(store, rows.orderBy(F.desc("owner_id") if k else "owner_id"))
        assert [r.name for r in store.read("foods").collect()] == ["last"]
    assert [(r.id, r.copies) for r in backup.differing_foods(rows).collect()] == [("3", 3)]
    clash = documents(spark, (1, {**GOOD, "foods": [{**FOOD, "barcode": "7"}, {**FOOD, "id": "4", "barcode": "7"}]}))
    with pytest.raises(ValueError, match="barcode 7"):
        backup.restore(store, clash)
    assert store.version() == 1


def test_pieces_are_the_same_bytes(spark, tmp_path):
    settings = spark.createDataFrame([(o, "settings", 'say "é"') for o in (1, 2, 3)], "owner_id long, id string, locale string")
    diary = entries(spark, (1, 5, 1, 1.5), (1, 3, 2, 9.0), (1, 3, 2, 9.0), (2, 1, 1, None), (7, 1, 1, 2.0))
    mine = foods(spark, 2, 10, name="a,]}").withColumn("owner_id", F.lit(1).cast("long"))
    weights = spark.createDataFrame([(2, "w", dt.date(2026, 8, 1), 70.0, "note"), (2, None, None, None, None)], "owner_id long, id string, date date, kg double, note string")
    whole = {r.owner_id: r.backup for r in backup.build(settings, mine, diary, weights, F.lit("2026-08-20")).collect()}
    pieces = backup.fragments(settings, mine, diary, weights, F.lit("2026-08-20"))
    texts = {}
    for r in pieces.orderBy("owner_id", "section", "id", "n").collect():
        texts[r.owner_id] = texts.get(r.owner_id, "") + r.text
    assert texts == whole and set(whole) == {1, 2, 3}
    backup.write_documents(pieces.repartition(5), str(tmp_path / "text"))
    written = "".join(p.read_text() for p in sorted((tmp_path / "text").glob("part-*")))
    assert written.replace("\n", "") == "".join(whole[k] for k in (1, 2, 3)) and [json.loads(x) for x in whole.values()]
    one, other = backup.read_fragments(pieces), backup.read(spark.createDataFrame(list(whole.items()), "owner_id long, backup string"))
    for name in ("settings", "foods", "weightEntries"):
        assert sorted(map(repr, one[name].collect())) == sorted(map(repr, other[name].select(*one[name].columns).collect())), name
    assert one["diaryEntries"].count() == other["diaryEntries"].count() + 1  # a document keeps the last of one id


def test_documents_of_one_owner_and_day_stay_apart(spark, tmp_path):
    rows = documents(spark, (1, {**GOOD, "exportedAt": "2026-08-20T01"}), (1, {**GOOD, "exportedAt": "2026-08-20T02"}), (2, "{}"))
    backup.export_files(rows.coalesce(1).select("owner_id", "backup"), str(tmp_path / "files"))
    got = backup.import_files(spark, str(tmp_path / "files")).collect()
    assert sorted((r.owner_id, r.error) for r in got if not r.error) == [(1, None), (1, None)] and len(got) == 3


def test_files_of_many_owners(spark, tmp_path):
    """A document's file is made without a checksum's beside it and opened once, and each folder isn't a task of its own."""
    days = ["2026-08-20", "a/../b:c", "", "{\u00e9}=%#", None]
    texts = [json.dumps({**GOOD, "exportedAt": days[o % 5], "n": o}) for o in range(120)]
    rows = spark.createDataFrame([*enumerate(texts), (3, texts[3]), (None, texts[7]), (-8, None)], "owner_id long, backup string")
    out = tmp_path / "files"
    backup.export_files(rows.coalesce(1), str(out))
    made = [p for p in out.rglob("*") if p.is_file() and "SUCCESS" not in p.name]
    assert len(made) == 123 and {p.parent.parent.parent for p in made} == {out} and not [p for p in made if p.name[0] in "._"]
    context = spark.sparkContext
    context.setJobGroup("import", "import")
    read = backup.import_files(spark, str(out))
    context.setLocalProperty("spark.jobGroup.id", None)
    status = context.statusTracker()
    assert max(status.getStageInfo(s).numTasks for j in status.getJobIdsForGroup("import") for s in status.getJobInfo(j).stageIds) <= 8
    for p in made:
        p.write_text("gone")
    got = sorted((str(r.owner_id), r.backup, r.error) for r in read.collect())
    assert got == sorted((str(r.owner_id), (r.backup or "") + "\n", None if r.backup else backup.INVALID) for r in rows.collect())
    with pytest.raises(FileExistsError):
        backup.export_files(rows, str(out))
    with pytest.raises(Exception, match="broken off"):
        backup.export_files(rows.withColumn("backup", F.when(F.col("owner_id") == 119, F.raise_error(F.lit("broken off"))).otherwise(F.col("backup"))), str(tmp_path / "half"))
    assert [p.name for p in tmp_path.iterdir()] == ["files"]
    (out / "stray.txt").write_text("{}")
    with pytest.raises(Exception, match="in no owner's folder"):
        backup.import_files(spark, str(out))


def test_local_files_are_as_the_sinks(spark, tmp_path, monkeypatch):
    """What tasks make in a local folder has the folders and bytes of what Spark's sink makes elsewhere."""
    days = ["2026-08-20T01", "a/../b:c", "", "[\u00e9]=%#\n", None, 5]
    rows = spark.createDataFrame([(o % 4 or None, json.dumps({"exportedAt": days[o % 6], "n": o})) for o in range(24)], "owner_id long, backup string")
    held = lambda at: sorted((str(p.parent.relative_to(at)), p.read_bytes()) for p in at.rglob("part-*"))
    backup.export_files(rows, str(tmp_path / "own"))
    monkeypatch.setattr(backup, "local_path", lambda *_: None)
    backup.export_files(rows, str(tmp_path / "sink"))
    assert held(tmp_path / "own") == held(tmp_path / "sink") and len(held(tmp_path / "own")) == 24


def test_work_folders_are_removed(spark):
    kept = dict(work._made)
    work._made.clear()
    path = work.written(spark.range(3).toDF("id"), "three")
    assert path.count() == 3 and work.remove_work() == 1
    with pytest.raises(Exception, match="(?i)PATH_NOT_FOUND|does not exist"):
        spark.read.parquet(path.inputFiles()[0])
    work._made.update(kept)
