"""Tables as Parquet folders: scans, lookups, keyed upserts and deletes, appends, replacement.

A change never edits files in place.  New rows are written beside the old ones,
and one file makes them current, so a reader or a lost job sees a whole version
or none.
"""

from __future__ import annotations

import json
import uuid
from collections import Counter
from collections.abc import Callable
from typing import Any

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from ..schemas import DEFAULT_SETTINGS, FIELDS, KEYS, NUTRIENTS, SETTINGS_FIELDS, schema
from . import guards
from .versions import Folder, Versions

ORDER = {"foods": ("name", "id"), "diaryEntries": ("date", "id"), "weightEntries": ("date", "id"), "settings": ("owner_id",)}


def survivors(changes: DataFrame, keys: tuple[str, ...], sequence: str | None = None) -> DataFrame:
    """Of changes with one key the last by ``sequence``; without one, and of ties, the greatest row, so that reruns agree."""
    columns = [c for c in changes.columns if c != sequence]
    order = Window.partitionBy(*keys).orderBy(*([F.desc(sequence)] if sequence else []), F.struct(*columns).desc())
    return changes.withColumn("_n", F.row_number().over(order)).where("_n = 1").select(*columns)


def upsert(table: DataFrame, changes: DataFrame, keys: tuple[str, ...], sequence: str | None = None) -> DataFrame:
    """``table`` with ``changes`` put over it by key, one row for each; see ``survivors``.

    The table itself is only anti-joined, so rows that don't change aren't sorted.
    """
    changes = survivors(changes, keys, sequence)
    return table.join(changes.select(*keys), list(keys), "left_anti").select(*table.columns).unionByName(changes.select(*table.columns))


def delete(table: DataFrame, doomed: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """``table`` without the keys; nothing cascades, diary rows keep their copies."""
    return table.join(doomed.select(*keys), list(keys), "left_anti").select(*table.columns)


def save_foods(foods: DataFrame, changes: DataFrame, now: Column, sequence: str | None = None) -> DataFrame:
    """Upsert of foods: ``updatedAt`` is now, ``createdAt`` stays or is now."""
    stamped = changes.withColumns({"createdAt": F.coalesce("createdAt", now), "updatedAt": now})
    return upsert(foods, stamped, KEYS["foods"], sequence)


def barcode_conflicts(foods: DataFrame) -> DataFrame:
    """Barcodes of more than one food.  Missing barcodes don't conflict."""
    return foods.where("barcode is not null").groupBy("barcode").agg(F.count("*").alias("n")).where("n > 1")


def save_settings(settings: DataFrame, changes: DataFrame, now: Column, sequence: str | None = None) -> DataFrame:
    """Upsert of whole settings rows; ``updatedAt`` is now."""
    return upsert(settings, changes.withColumn("updatedAt", now), KEYS["settings"], sequence)


def save_weights(weights: DataFrame, settings: DataFrame, changes: DataFrame, today: Column, now: Column, sequence: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Upsert of weigh-ins; today's also becomes the profile's current weight, with ``updatedAt`` now.

    Of several of today the last by ``sequence`` counts (without one, and of ties, the greatest id), among those that are saved.
    """
    last = F.struct(*([F.col(sequence)] if sequence else []), F.col("id"))
    ordered = changes.withColumn("_last", last)
    saved = survivors(ordered, KEYS["weightEntries"], sequence)
    fresh = saved.where(F.col("date") == today).groupBy("owner_id").agg(F.max_by("kg", "_last").alias("_kg"))
    joined = settings.join(fresh, "owner_id", "left")
    synced = joined.withColumns(
        {
            "profile": F.col("profile").withField("currentWeightKg", F.coalesce("_kg", "profile.currentWeightKg")),
            "updatedAt": F.when(F.col("_kg").isNotNull(), now).otherwise(F.col("updatedAt")),
        }
    )
    return upsert(weights, saved.drop("_last"), KEYS["weightEntries"]), synced.select(*settings.columns)


def default_settings(owners: DataFrame, now: Column) -> DataFrame:
    """The default row of each of ``owners(owner_id)``."""
    fields = SETTINGS_FIELDS.replace("owner_id: long, ", "")
    row = F.from_json(F.lit(json.dumps(DEFAULT_SETTINGS)), f"struct<{fields}>")
    return owners.select("owner_id", row.alias("s")).select("owner_id", "s.*").withColumn("updatedAt", now)


def with_defaults(settings: DataFrame, owners: DataFrame, now: Column) -> DataFrame:
    """Settings, and the default row of owners that have none."""
    missing = owners.join(settings, "owner_id", "left_anti")
    return settings.unionByName(default_settings(missing, now).select(*settings.columns))


#: Rows of a bucket lie in this order, so that row groups can be passed over by their bounds.
SORTED = {"foods": ("id",), "diaryEntries": ("owner_id", "date", "id"), "weightEntries": ("owner_id", "date", "id"), "settings": ("owner_id",)}
#: Columns with a Bloom filter in each row group, for lookups whose values lie anywhere.
FILTERED = {"foods": ("id", "barcode"), "diaryEntries": ("id",), "weightEntries": ("id",), "settings": ()}
#: So many folders of about one size are merged into one.
FANOUT = 8
#: A change that others overtake is tried again so often.
ATTEMPTS = 20
#: Sums of the diary are kept as decimals, which come out the same in any order and leave nothing behind when a row is taken off.
_SUM = "decimal(38, 18)"


class Conflict(RuntimeError):
    """Others kept changing the store."""


def level(rows: int) -> int:
    """The order of magnitude of a folder, to the base of ``FANOUT``."""
    out = 0
    while rows >= FANOUT:
        rows, out = rows // FANOUT, out + 1
    return out


def due(rows: dict[str, int]) -> list[str]:
    """Of folders and their numbers of rows, those to be merged: all of the smallest magnitude that has ``FANOUT`` of them.

    So of each magnitude fewer than ``FANOUT`` stay, and a row is rewritten once a magnitude.
    """
    by: dict[int, list[str]] = {}
    for folder, n in rows.items():
        by.setdefault(level(n), []).append(folder)
    return next((by[k] for k in sorted(by) if len(by[k]) >= FANOUT), [])


class Store:
    """The four tables under one folder, on any file system that Spark knows.

    *Layout.*  A row lies in the bucket of its key's hash.  A folder of rows has a folder for each bucket, and a version says which
    buckets of which folders are current.  So a change to some keys rewrites the buckets that they fall into and
    nothing else, and rows that are appended are written alone.  ``buckets`` is fixed by the first version.

    *Versions.*  A change is made against the version that it has read, and takes the next number if nobody else has.  If someone has, it is
    checked and made again against what is there now; so no rule that held for each of two writers is broken by both.

    *Rules.*  Keys are there and unique, numbers are finite, barcodes belong to one food: on every write.

    *Daily sums.*  Each change to the diary leaves what it adds to, and takes from, the sums by owner and day.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 16):
        self.spark, self.path = spark, path.rstrip("/")
        self.folder = Folder(spark, self.path)
        self.log = Versions(self.folder, {"buckets": buckets, "tables": {name: {} for name in FIELDS}, "sums": {}, "batches": {}})

    # ------------------------------------------------------------ versions

    def version(self) -> int:
        """The number of the current version, 0 if there is none."""
        return max(self.log.numbers(), default=0)

    def _commit(self, change: Callable[[dict[str, Any], list[str]], dict[str, Any] | None], written: list[str]) -> int:
        """Make ``change(now, written)`` current, or nothing if it is None; it is called again where others came first.

        ``written`` lists the folders made so far; those that the new version doesn't name are removed, all of them after an error.
        """
        named: dict[str, Any] = {}
        try:
            for _ in range(ATTEMPTS):
                number, now = self.log.latest()
                new = change(now, written)
                if new is None:
                    return number
                if self.log.create(number + 1, new):
                    named = new
                    return number + 1
            raise Conflict(f"{self.path} was changed {ATTEMPTS} times meanwhile")
        finally:
            kept = _folders(named)
            for folder in written:
                if folder not in kept:
                    self.folder.remove(folder)

    def vacuum(self, keep: int = 10, seconds: float = 86_400) -> int:
        """Forget all but the last ``keep`` versions, and remove folders that none of these names; how many.

        Folders changed within ``seconds`` stay, as someone may be about to name them.
        """
        kept = {f for manifest in self.log.forget(keep) for f in _folders(manifest)}
        gone = [f"{top}/{n}" for top in ("data", "sums") for n in self.folder.names(top) if f"{top}/{n}" not in kept and self.folder.age(f"{top}/{n}") >= seconds]
        for folder in gone:
            self.folder.remove(folder)
        return len(gone)

    # ------------------------------------------------------------- folders

    def _bucket(self, name: str, buckets: int) -> Column:
        return F.pmod(F.xxhash64(*KEYS[name]), F.lit(buckets)).cast("int")

    def _write(self, name: str, rows: DataFrame, buckets: int, written: list[str], rejects: str = "error") -> tuple[str, dict[str, Any]]:
        """A new folder of rows, and what a version says of it.

        Rows that break a rule of ``guards`` are counted as the others are written and never stored; they are an error, unless ``rejects`` is "drop".
        """
        folder, seen, broken = f"data/{name}-{uuid.uuid4().hex}", Observation(), guards.rules(name)
        written.append(folder)
        checked = rows.select(*schema(name).names).withColumn("_broken", guards.breaches(name))
        counts = [F.count_if(F.array_contains("_broken", rule)).alias(f"r{k}") for k, rule in enumerate(broken)]
        good = checked.observe(seen, F.count_if(F.size("_broken") == 0).alias("rows"), *counts).where("size(_broken) = 0").drop("_broken")
        # Large buckets are split and small ones put together as they turn out to be.
        dealt = good.withColumn("bucket", self._bucket(name, buckets)).hint("rebalance", "bucket").sortWithinPartitions("bucket", *SORTED[name])
        out = dealt.write.partitionBy("bucket").option("parquet.bloom.filter.adaptive.enabled", "true")
        for column in FILTERED[name]:
            out = out.option(f"parquet.bloom.filter.enabled#{column}", "true")
        out.parquet(f"{self.path}/{folder}")
        found = _observed(seen)
        if rejects != "drop" and (reasons := {rule: n for k, rule in enumerate(broken) if (n := found[f"r{k}"])}):
            raise ValueError(f"{name} can't be stored: " + ", ".join(f"{rule} ({n} rows)" for rule, n in reasons.items()))
        filled = sorted(int(n.split("=")[1]) for n in self.folder.names(folder) if n.startswith("bucket="))
        return folder, {"rows": found["rows"], "buckets": filled}

    def _rows(self, name: str, table: dict[str, Any], buckets: set[int] | None = None) -> DataFrame:
        """The rows of a version's table, or of some of its buckets."""
        paths = [f"{self.path}/{f}/bucket={b}" for f, said in table.items() for b in said["buckets"] if buckets is None or b in buckets]
        return self.spark.read.schema(schema(name)).parquet(*paths) if paths else self.spark.createDataFrame([], schema(name))

    def read(self, name: str, ordered: bool = False, version: int | None = None) -> DataFrame:
        """A table of the current version, or of an earlier one that isn't forgotten (empty if there is none), by name or date if ``ordered``."""
        now = self.log.latest()[1] if version is None else self.log.read(version)
        out = self._rows(name, now["tables"][name])
        return out.orderBy(*ORDER[name]) if ordered else out

    def lookup(self, name: str, column: str, values: list, owner_id: int | None = None) -> DataFrame:
        """The rows whose ``column`` is one of a few ``values``, of one owner if told.

        Only the buckets are read that the keys fall into, if all of the key is told; and of these, as of all others, only
        row groups whose bounds and Bloom filter hold a value.
        """
        _, now = self.log.latest()
        where, keys = F.col(column).isin(values), KEYS[name]
        if "owner_id" in keys and owner_id is not None:
            where &= F.col("owner_id") == owner_id
        buckets = None
        if set(keys) - {"owner_id"} == {column} and ("owner_id" not in keys or owner_id is not None):
            known = {f.name: f.dataType.simpleString() for f in schema(name).fields}
            asked = self.spark.createDataFrame([(v,) for v in values], f"{column} {known[column]}")
            if "owner_id" in keys:
                asked = asked.withColumn("owner_id", F.lit(owner_id).cast("long"))
            buckets = {r[0] for r in asked.select(self._bucket(name, now["buckets"])).collect()}
        return self._rows(name, now["tables"][name], buckets).where(where)

    # ------------------------------------------------------------- changes

    def _check(self, name: str, now: dict[str, Any], folder: str, said: dict[str, Any], replacing: bool) -> None:
        """Whether a new folder of rows may stand beside a version's: keys are new (unless ``replacing``) and come once, barcodes are unique."""
        keys = list(KEYS[name])
        new = self._rows(name, {folder: said})
        if not replacing:
            twice = new.groupBy(*keys).count().where("count > 1").select(*keys)
            there = self._rows(name, now["tables"][name], set(said["buckets"])).select(*keys)
            if clash := new.select(*keys).join(there, keys, "left_semi").unionByName(twice).first():
                raise ValueError(f"{name} {clash[keys[-1]]} exists" + (f" for owner {clash[keys[0]]}" if len(keys) > 1 else ""))
        if name == "foods":
            coded = new.where("barcode is not null").select("id", "barcode")
            others = self._rows(name, now["tables"][name]).where("barcode is not null").select("id", "barcode").join(coded.select("barcode").distinct(), "barcode", "left_semi")
            if replacing:
                others = others.join(new.select("id"), "id", "left_anti")
            if clash := barcode_conflicts(coded.unionByName(others)).first():
                raise ValueError(f"barcode {clash['barcode']} belongs to {clash['n']} foods")

    def _sums(self, now: dict[str, Any], added: DataFrame | None, taken: DataFrame | None, written: list[str]) -> dict[str, Any]:
        """A version's sums with those of diary rows that come and go."""
        signed = [(rows, sign) for rows, sign in ((added, 1), (taken, -1)) if rows is not None]
        parts = [
            rows.groupBy("owner_id", "date").agg(
                (F.count("*") * sign).alias("entries"),
                *[(F.sum(F.col(f"nutritionSnapshot.{n}").cast(_SUM)) * sign).cast(_SUM).alias(n) for n in NUTRIENTS],
                *[(F.count(f"nutritionSnapshot.{n}") * sign).alias(f"known_{n}") for n in NUTRIENTS],
            )
            for rows, sign in signed
        ]
        return {**now["sums"], **self._write_sums(parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1]), written)}

    def _write_sums(self, parts: DataFrame, written: list[str]) -> dict[str, int]:
        folder, seen = f"sums/{uuid.uuid4().hex}", Observation()
        written.append(folder)
        added = [F.sum(c).alias(c) for c in ("entries", *(f"known_{n}" for n in NUTRIENTS))]
        merged = parts.groupBy("owner_id", "date").agg(*added, *[F.sum(n).cast(_SUM).alias(n) for n in NUTRIENTS])
        merged.observe(seen, F.count(F.lit(1)).alias("rows")).sortWithinPartitions("owner_id", "date").write.parquet(f"{self.path}/{folder}")
        return {folder: _observed(seen)["rows"]}

    def daily_sums(self) -> DataFrame:
        """``owner_id, date, entries`` and each nutrient's sum of the diary's days, without reading the diary; null where none is known.

        Values are summed as decimals of 18 places, so what is taken away leaves no trace.
        """
        _, now = self.log.latest()
        if not now["sums"]:
            return self.spark.createDataFrame([], "owner_id long, date date, entries long, " + ", ".join(f"{n} double" for n in NUTRIENTS))
        parts = self.spark.read.parquet(*[f"{self.path}/{f}" for f in now["sums"]])
        known = parts.groupBy("owner_id", "date").agg(F.sum("entries").alias("entries"), *[F.when(F.sum(f"known_{n}") > 0, F.sum(n)).cast("double").alias(n) for n in NUTRIENTS])
        return known.where("entries > 0")

    def replace(self, rejects: str = "error", **tables: DataFrame) -> None:
        """Write the given tables whole as the next version, beside the others as they are."""
        made: dict[int, dict[str, tuple[str, dict[str, Any]]]] = {}
        sums: dict[str, Any] = {}

        def change(now: dict[str, Any], written: list[str]) -> dict[str, Any]:
            # Written once, but for a first version of another number of buckets that came between.
            if (buckets := now["buckets"]) not in made:
                made[buckets] = {name: self._write(name, rows, buckets, written, rejects) for name, rows in tables.items()}
                for name, new_one in made[buckets].items():
                    self._check(name, {"tables": {name: {}}}, *new_one, replacing=False)
            new = made[buckets]
            if "diaryEntries" in tables and not sums:
                sums.update(self._sums({"sums": {}}, self._rows("diaryEntries", dict([new["diaryEntries"]])), None, written))
            return {**now, "tables": {**now["tables"], **{n: {f: said} for n, (f, said) in new.items()}}, "sums": dict(sums) if "diaryEntries" in tables else now["sums"]}

        self._commit(change, [])

    def append(self, name: str, rows: DataFrame, batch: tuple[str, int] | None = None, rejects: str = "error") -> None:
        """Add rows to a table; none of what is there is written again.  A key that is there already, or comes twice, is an error.

        ``batch`` names a stream and the number of its batch: one that isn't above the last one kept with the version was stored before and adds nothing.
        Small folders are merged once there are many.
        """
        made: dict[int, tuple[str, dict[str, Any]]] = {}
        sums: dict[str, Any] = {}

        def change(now: dict[str, Any], written: list[str]) -> dict[str, Any] | None:
            if batch and now["batches"].get(batch[0], -1) >= batch[1]:
                return None
            if (buckets := now["buckets"]) not in made:
                made[buckets] = self._write(name, rows, buckets, written, rejects)
            folder, said = made[buckets]
            self._check(name, now, folder, said, replacing=False)
            if name == "diaryEntries" and not sums:
                sums.update(self._sums({"sums": {}}, self._rows(name, {folder: said}), None, written))
            batches = {**now["batches"], batch[0]: batch[1]} if batch else now["batches"]
            return {**now, "tables": {**now["tables"], name: {**now["tables"][name], folder: said}}, "sums": {**now["sums"], **sums}, "batches": batches}

        self._commit(change, [])
        self._tidy(name)

    def sink(self, name: str, stream: str) -> Callable[[DataFrame, int], None]:
        """For ``foreachBatch``: appends each batch of a stream once, also if it is run again."""
        return lambda rows, number: self.append(name, rows, (stream, number))

    def upsert(self, name: str, changes: DataFrame, sequence: str | None = None, rejects: str = "error") -> None:
        """Put ``changes`` over a table by key (see ``survivors``).  Only the buckets that a changed row is in are rewritten; new keys alone are appended."""
        self._put(name, lambda buckets, written: self._write(name, survivors(changes, KEYS[name], sequence), buckets, written, rejects), keep=True)

    def delete(self, name: str, doomed: DataFrame) -> None:
        """Drop keys from a table; only the buckets that one is in are rewritten."""

        def keys(buckets: int, written: list[str]) -> tuple[str, dict[str, Any]]:
            null = [F.col(f.name) if f.name in KEYS[name] else F.lit(None).cast(f.dataType).alias(f.name) for f in schema(name).fields]
            return self._write(name, doomed.select(*KEYS[name]).distinct().select(*null), buckets, written)

        self._put(name, keys, keep=False)

    def _put(self, name: str, stage: Callable[[int, list[str]], tuple[str, dict[str, Any]]], keep: bool) -> None:
        keys = list(KEYS[name])
        made: dict[int, tuple[str, dict[str, Any]]] = {}

        def change(now: dict[str, Any], written: list[str]) -> dict[str, Any] | None:
            if (buckets := now["buckets"]) not in made:
                made[buckets] = stage(buckets, written)
            folder, said = made[buckets]
            new = self._rows(name, {folder: said})
            if keep:
                self._check(name, now, folder, said, replacing=True)
            table = now["tables"][name]
            old = self._rows(name, table, set(said["buckets"]))
            hit = old.join(new.select(*keys), keys, "left_semi")
            touched = {r[0] for r in hit.select(self._bucket(name, now["buckets"])).distinct().collect()}
            if not touched and not (keep and said["rows"]):
                return None
            sums = self._sums(now, new if keep else None, hit if touched else None, written) if name == "diaryEntries" else now["sums"]
            # Of buckets without a changed row the new rows are current as they were staged.
            fresh = {folder: {**said, "buckets": [b for b in said["buckets"] if b not in touched]}} if keep else {}
            if touched:
                rest = self._rows(name, table, touched).join(new.select(*keys), keys, "left_anti")
                merged = rest.unionByName(new.where(self._bucket(name, now["buckets"]).isin(sorted(touched)))) if keep else rest
                fresh |= dict([self._write(name, merged, now["buckets"], written)])
                table = {f: {**x, "buckets": [b for b in x["buckets"] if b not in touched]} for f, x in table.items()}
            return {**now, "tables": {**now["tables"], name: {f: x for f, x in {**table, **fresh}.items() if x["buckets"]}}, "sums": sums}

        self._commit(change, [])
        self._tidy(name)

    def compact(self, name: str) -> int:
        """Merge folders of a table, and of the daily sums, while many are of one size; how many times.

        The number of folders stays below ``FANOUT`` for each order of magnitude of rows.
        """
        merges = 0

        def change(now: dict[str, Any], written: list[str]) -> dict[str, Any] | None:
            nonlocal merges
            table, sums = now["tables"][name], now["sums"]
            small, few = due({f: said["rows"] for f, said in table.items()}), due(sums) if name == "diaryEntries" else []
            if not small and not few:
                return None
            merges += 1
            if small:
                merged = self._write(name, self._rows(name, {f: table[f] for f in small}), now["buckets"], written)
                table = {**{f: said for f, said in table.items() if f not in small}, **dict([merged])}
            if few:
                sums = {**{f: n for f, n in sums.items() if f not in few}, **self._write_sums(self.spark.read.parquet(*[f"{self.path}/{f}" for f in few]), written)}
            return {**now, "tables": {**now["tables"], name: table}, "sums": sums}

        before = -1
        while before != merges:
            before = merges
            self._commit(change, [])
        return merges

    def _tidy(self, name: str) -> None:
        """Merge folders after a change, which stands also if others leave no room to merge."""
        try:
            self.compact(name)
        except Conflict:
            pass

    def save_foods(self, changes: DataFrame, now: Column, sequence: str | None = None) -> None:
        """Upsert of foods: ``updatedAt`` is now, ``createdAt`` stays or is now."""
        self.upsert("foods", changes.withColumns({"createdAt": F.coalesce("createdAt", now), "updatedAt": now}), sequence)

    def erase(self, owners: DataFrame, now: Column) -> None:
        """Empty tables, and default settings."""
        empty = {name: self.spark.createDataFrame([], schema(name)) for name in FIELDS}
        self.replace(**{**empty, "settings": default_settings(owners, now)})

    def log_foods(self, snapshots: DataFrame) -> None:
        """Append diary rows; a row whose id is there already is an error."""
        self.append("diaryEntries", snapshots)


def _observed(seen: Observation) -> Counter:
    """What was observed; nothing of each, where Spark knew that there are no rows and left the observation out of the plan."""
    try:
        return Counter(seen.get)
    except Py4JJavaError as error:
        if error.java_exception.getClass().getSimpleName() != "AssertionError":
            raise
        return Counter()


def _folders(manifest: dict[str, Any]) -> set[str]:
    """The folders that a version names."""
    return {f for table in manifest.get("tables", {}).values() for f in table} | set(manifest.get("sums", {}))
