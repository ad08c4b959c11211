"""The store's layout, its commits and what it keeps beside its tables."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from victual.operators import budget
from victual.schemas import NUTRIENTS, schema
from victual.sources import guards, store as stores
from victual.sources.store import Conflict, Store
from victual.sources.versions import Folder, Versions
from tests.test_golden import food


def foods(spark, *ids, **fields):
    """Foods with a barcode of their own."""
    out = food(spark, **fields).drop("id", "barcode").crossJoin(spark.createDataFrame([(str(i), f"b{i}") for i in ids], "id string, barcode string"))
    return out.select(*schema("foods").names)


def entries(spark, *rows):
    """``(owner, id, day, kcal)``."""
    flat = spark.createDataFrame([(o, str(i), dt.date(2026, 8, d), k) for o, i, d, k in rows], "owner_id long, id string, date date, kcal double")
    kind = schema("diaryEntries")["nutritionSnapshot"].dataType
    snapshot = F.struct(*[(F.col("kcal") if f.name == "kcal" else F.when(F.col("kcal") > 5, F.col("kcal") / 3) if f.name == "fatG" else F.lit(None)).cast("double").alias(f.name) for f in kind.fields])
    have = {"owner_id", "id", "date"}
    return flat.select(*[F.col(f.name) if f.name in have else snapshot.alias(f.name) if f.name == "nutritionSnapshot" else F.lit(None).cast(f.dataType).alias(f.name) for f in schema("diaryEntries").fields])


def folders(store, name="foods"):
    return {f: set(said["buckets"]) for f, said in store.log.latest()[1]["tables"][name].items()}


def ids(store, name="foods"):
    return sorted((r.id for r in store.read(name).collect()), key=int)


def test_a_change_rewrites_the_buckets_it_touches(spark, tmp_path):
    store = Store(spark, str(tmp_path), buckets=8)
    store.replace(foods=foods(spark, *range(40)))
    (first, whole), = folders(store).items()
    assert whole == set(range(8))
    store.upsert("foods", foods(spark, 7, name="new"))
    after = folders(store)
    (fresh,) = after.keys() - {first}
    assert len(after[fresh]) == 1 and after[first] == whole - after[fresh]
    written = [p.name for p in (tmp_path / fresh).iterdir() if p.name.startswith("bucket=")]
    assert written == [f"bucket={b}" for b in after[fresh]]  # of eight buckets one is written again
    assert ids(store) == [str(i) for i in range(40)] and [r.name for r in store.read("foods").where("id = '7'").collect()] == ["new"]
    store.delete("foods", foods(spark, 7, 90).select("id"))
    assert ids(store) == [str(i) for i in range(40) if i != 7]
    now = store.version()
    store.delete("foods", foods(spark, 7, 90).select("id"))  # nothing to do
    assert store.version() == now and store.read("foods", version=1).count() == 40


def test_new_keys_alone_are_appended(spark, tmp_path):
    store = Store(spark, str(tmp_path), buckets=8)
    store.replace(foods=foods(spark, *range(20)))
    (first, whole), = folders(store).items()
    store.upsert("foods", foods(spark, *range(20, 25)))
    assert folders(store)[first] == whole and len(folders(store)) == 2 and store.read("foods").count() == 25


def test_barcodes_are_unique_however_foods_come(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    store.append("foods", foods(spark, 1, 2))
    twin = foods(spark, 1).withColumn("id", F.lit("9"))
    for attempt in (store.append, store.upsert):
        with pytest.raises(ValueError, match="barcode b1 belongs to 2 foods"):
            attempt("foods", twin)
    with pytest.raises(ValueError, match="barcode b1"):
        store.append("foods", twin.unionByName(twin.withColumn("id", F.lit("10"))))
    store.upsert("foods", foods(spark, 1, name="renamed"))  # its own barcode
    swapped = foods(spark, 1, 2).withColumn("barcode", F.when(F.col("id") == "1", "b2").otherwise("b1"))
    store.upsert("foods", swapped)  # each takes the other's
    store.append("foods", foods(spark, 3, 4).withColumn("barcode", F.lit(None).cast("string")))
    assert {r.id: r.barcode for r in store.read("foods").collect()} == {"1": "b2", "2": "b1", "3": None, "4": None}


def overtaken(monkeypatch, store, other):
    """``other`` changes the store once, between what ``store`` reads and what it makes current."""
    real, done = store.log.create, []

    def create(number, manifest):
        if not done:
            done.append(1)
            other()
        return real(number, manifest)

    monkeypatch.setattr(store.log, "create", create)


def test_of_two_writers_of_one_barcode_one_fails(spark, tmp_path, monkeypatch):
    mine, other = Store(spark, str(tmp_path)), Store(spark, str(tmp_path))
    mine.append("foods", foods(spark, 1))
    overtaken(monkeypatch, mine, lambda: other.append("foods", foods(spark, 2)))
    with pytest.raises(ValueError, match="barcode b2 belongs to 2 foods"):
        mine.append("foods", foods(spark, 2).withColumn("id", F.lit("3")))
    assert ids(mine) == ["1", "2"] and mine.version() == 2
    assert {p.name for p in (tmp_path / "data").iterdir()} == {f.split("/")[1] for f in folders(mine)}  # nothing is left of the one that failed


def test_writers_that_do_not_clash_both_succeed(spark, tmp_path, monkeypatch):
    mine, other = Store(spark, str(tmp_path)), Store(spark, str(tmp_path))
    mine.replace(foods=foods(spark, 1, 2), diaryEntries=entries(spark, (1, 1, 1, 3.0)))
    overtaken(monkeypatch, mine, lambda: other.upsert("foods", foods(spark, 2, name="other")))
    mine.upsert("foods", foods(spark, 1, 5, name="mine"))
    assert {r.id: r.name for r in mine.read("foods").collect()} == {"1": "mine", "2": "other", "5": "mine"}
    overtaken(monkeypatch, mine, lambda: other.append("diaryEntries", entries(spark, (1, 2, 1, 4.0))))
    mine.append("diaryEntries", entries(spark, (1, 3, 1, 5.0)))
    assert ids(mine, "diaryEntries") == ["1", "2", "3"] and mine.daily_sums().first().kcal == 12
    with pytest.raises(ValueError, match="diaryEntries 3 exists for owner 1"):
        other.append("diaryEntries", entries(spark, (1, 3, 9, 5.0)))


def test_the_first_version_fixes_the_buckets(spark, tmp_path, monkeypatch):
    """Someone else's first version has another number of buckets: what was written for ours is written again."""
    for k, name in enumerate(("append", "upsert", "replace")):
        mine, other = Store(spark, str(tmp_path / name), buckets=3), Store(spark, str(tmp_path / name), buckets=5)
        overtaken(monkeypatch, mine, lambda: other.append("weightEntries", mine.read("weightEntries")))
        mine.replace(foods=foods(spark, *range(30))) if name == "replace" else getattr(mine, name)("foods", foods(spark, *range(30)))
        assert mine.log.latest()[1]["buckets"] == 5 and mine.version() == 2
        assert [r.id for r in mine.lookup("foods", "id", ["17"]).collect()] == ["17"] and ids(mine) == [str(i) for i in range(30)]
        mine.upsert("foods", foods(spark, 17, name="new"))
        assert len(ids(mine)) == 30


def test_a_writer_gives_up_in_the_end(spark, tmp_path, monkeypatch):
    store = Store(spark, str(tmp_path))
    monkeypatch.setattr(stores, "ATTEMPTS", 2)
    monkeypatch.setattr(store.log, "create", lambda number, manifest: False)
    with pytest.raises(Conflict):
        store.append("foods", foods(spark, 1))
    assert list((tmp_path / "data").iterdir()) == []


@pytest.mark.parametrize("renaming", [False, True])
def test_a_version_is_taken_once(spark, tmp_path, monkeypatch, renaming):
    folder = Folder(spark, str(tmp_path))
    if renaming:
        monkeypatch.setattr(folder, "_take", folder._rename)
    log = Versions(folder, {"n": 0})
    assert log.latest() == (0, {"n": 0}) and log.create(1, {"n": 1}) and not log.create(1, {"n": 2}) and log.create(2, {"n": 3})
    assert log.read(1) == {"n": 1} and log.latest() == (2, {"n": 3})
    assert not [p for p in tmp_path.iterdir() if p.name.startswith("_staged")]


def test_a_batch_that_comes_again_adds_nothing(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    log = store.sink("diaryEntries", "phone")
    for number in (0, 1, 1, 0):
        log(entries(spark, (1, number, 1, 1.0)), number)
    assert ids(store, "diaryEntries") == ["0", "1"] and store.version() == 2
    store.sink("diaryEntries", "watch")(entries(spark, (1, 7, 1, 1.0)), 0)  # another stream's numbers are its own
    assert ids(store, "diaryEntries") == ["0", "1", "7"] and len(list((tmp_path / "data").iterdir())) == 3


def test_folders_stay_few_after_many_appends():
    rows, merged = {}, 0
    for k in range(1000):
        rows[f"a{k}"] = 10
        while some := stores.due(rows):
            merged += sum(rows[f] for f in some)
            rows[f"m{k}-{len(rows)}"] = sum(rows.pop(f) for f in some)
    assert sum(rows.values()) == 10_000 and len(rows) < 4 * stores.FANOUT and merged <= 4 * 10_000  # a row is rewritten a few times
    assert stores.due({}) == [] and stores.level(0) == 0 and stores.level(64) == 2


def test_compaction(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(stores, "FANOUT", 3)
    store = Store(spark, str(tmp_path), buckets=2)
    for k in range(7):
        store.append("diaryEntries", entries(spark, (1, k, k + 1, 1.0)))
    assert ids(store, "diaryEntries") == [str(k) for k in range(7)]
    assert len(folders(store, "diaryEntries")) <= 4 and len(store.log.latest()[1]["sums"]) <= 4
    assert sorted(r.date.day for r in store.daily_sums().collect()) == list(range(1, 8))
    before = len(list((tmp_path / "data").iterdir()))
    assert store.vacuum(keep=1, seconds=3600) == 0  # too young
    assert store.vacuum(keep=1, seconds=0) > 0
    assert len(list((tmp_path / "data").iterdir())) == len(folders(store, "diaryEntries")) < before
    assert ids(store, "diaryEntries") == [str(k) for k in range(7)] and store.log.numbers() == [store.version()]


def test_daily_sums_equal_those_of_the_diary(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    assert store.daily_sums().count() == 0

    def agree():
        want = {(r.owner_id, r.date): [r[n] for n in NUTRIENTS] for r in budget.daily_totals(store.read("diaryEntries")).collect()}
        got = {(r.owner_id, r.date): [r[n] for n in NUTRIENTS] for r in store.daily_sums().collect()}
        assert got.keys() == want.keys()
        for key, values in got.items():
            assert [v is None for v in values] == [v is None for v in want[key]]
            assert all(v is None or math.isclose(v, w, abs_tol=1e-9) for v, w in zip(values, want[key]))

    store.replace(diaryEntries=entries(spark, (1, 1, 1, 0.1), (1, 2, 1, 0.2), (1, 3, 2, 7.7), (2, 1, 1, None)))
    agree()
    store.append("diaryEntries", entries(spark, (1, 4, 1, 0.3), (3, 1, 5, 9.0)))
    agree()
    store.upsert("diaryEntries", entries(spark, (1, 2, 3, 8.0), (1, 9, 1, 1.0)))  # one moves to another day
    agree()
    store.delete("diaryEntries", entries(spark, (1, 3, 2, 0.0), (3, 1, 1, 0.0)).select("owner_id", "id"))
    agree()
    assert (1, dt.date(2026, 8, 2)) not in {(r.owner_id, r.date) for r in store.daily_sums().collect()}
    assert all("/sums/" in f for f in store.daily_sums().inputFiles())


def rows_read(df):
    """Rows that the scans of a query hand on, once it has run."""
    df.collect()
    out, todo = 0, [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        name = node.nodeName()
        if name.startswith("AdaptiveSparkPlan"):
            todo.append(node.executedPlan())
        elif "QueryStage" in name:
            todo.append(node.plan())
        else:
            if name.startswith("Scan"):
                out += node.metrics().get("numOutputRows").get().value()
            todo += [node.children().apply(i) for i in range(node.children().size())]
    return out


def test_lookups_pass_over_buckets_and_row_groups(spark, tmp_path):
    store = Store(spark, str(tmp_path), buckets=4)
    codes = spark.range(4000).select(F.col("id").cast("string").alias("id"), F.sha2(F.col("id").cast("string"), 256).alias("barcode"))  # in no order
    store.replace(foods=food(spark).drop("id", "barcode").crossJoin(codes).select(*schema("foods").names))
    by_id = store.lookup("foods", "id", ["17"])
    assert [r.id for r in by_id.collect()] == ["17"] and rows_read(by_id) < 1500  # a bucket of four
    code = codes.where("id = '17'").first().barcode
    by_code = store.lookup("foods", "barcode", [code])
    assert [r.id for r in by_code.collect()] == ["17"] and rows_read(by_code) < 2500  # filters of the other buckets' row groups say no
    unknown = store.lookup("foods", "barcode", [code[:-1] + "x"])
    assert rows_read(unknown) < 2500 and unknown.count() == 0 and rows_read(store.read("foods")) == 4000
    store.append("diaryEntries", entries(spark, (1, 5, 1, 1.0), (2, 5, 1, 1.0)))
    assert [r.owner_id for r in store.lookup("diaryEntries", "id", ["5"], owner_id=2).collect()] == [2] and store.lookup("diaryEntries", "id", ["5"]).count() == 2


def test_rows_that_break_a_rule_are_never_stored(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    rows = entries(spark, (1, 1, 1, 1.0), (1, 2, 1, math.nan), (1, 3, 1, math.inf), (None, 4, 1, 1.0))
    with pytest.raises(ValueError, match=r"owner_id: missing \(1 rows\), nutritionSnapshot: not finite \(2 rows\)"):
        store.append("diaryEntries", rows)
    assert store.version() == 0 and list((tmp_path / "data").iterdir()) == []
    store.append("diaryEntries", rows, rejects="drop")
    assert ids(store, "diaryEntries") == ["1"] and store.daily_sums().first().entries == 1
    assert {r.id: r.reasons for r in guards.rejected("diaryEntries", rows).collect()} == {"2": ["nutritionSnapshot: not finite"], "3": ["nutritionSnapshot: not finite"], "4": ["owner_id: missing"]}
    with pytest.raises(ValueError, match="id: missing"):
        store.delete("diaryEntries", entries(spark, (1, 1, 1, 1.0)).select("owner_id", F.lit(None).cast("string").alias("id")))
