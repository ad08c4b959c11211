"""Extension: totals by owner and day as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numbers import round_display
from ..sources.store import Store
from ..sources.work import shared_folder


def daily_energy(entries: DataFrame, time: str = "at", late: str = "2 days") -> DataFrame:
    """Energy by ``owner_id`` and day of a stream (or table) of ``owner_id, at, kcal``.

    In append or update mode a day's state goes when the stream has passed it by
    ``late``, and rows that come later than that are dropped.
    """
    return entries.withWatermark(time, late).groupBy("owner_id", F.window(time, "1 day")).agg(F.sum("kcal").alias("kcal"))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a stream."""
    path = f"{sf_dir}/events.parquet"
    # A stream reads folders; a table of a single file is picked from its folder by name.
    folder, _, name = path.rpartition("/")
    source = spark.readStream.schema(spark.read.parquet(path).schema)
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    single = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(hadoop).isFile()
    return source.option("pathGlobFilter", name).parquet(folder) if single else source.parquet(path)


def into_store(rows: DataFrame, store: Store, name: str, stream: str, checkpoint: str) -> None:
    """Append all that a stream has to a table of a store; a batch that is run again adds nothing."""
    running = rows.writeStream.foreachBatch(store.sink(name, stream)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    running.awaitTermination()


def quick_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``owner_id, date, kcal`` of the events without a food, read as a stream until it is exhausted."""
    stream = events(spark, sf_dir)
    rows = stream.where("event_type <> 'signup' and event_id % 11 = 0").select(F.col("user_id").alias("owner_id"), F.col("ts").cast("timestamp").alias("at"), F.col("value").alias("kcal"))
    place = shared_folder(spark, "daily")
    folders: list[str] = []

    def keep(batch: DataFrame, number: int) -> None:
        """The days that a micro-batch has changed, in a folder of its own; a retried one overwrites it."""
        folders.append(f"{place}/batch-{number}")
        batch.withColumn("batch", F.lit(number).cast("long")).write.mode("overwrite").parquet(folders[-1])

    running = daily_energy(rows).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{place}/state").trigger(availableNow=True).start()
    running.awaitTermination()
    if not folders:
        return spark.createDataFrame([], "owner_id long, date date, kcal double")
    days = spark.read.parquet(*folders)
    last = days.groupBy("owner_id", "window.start").agg(F.max_by("kcal", "batch").alias("kcal"))
    return last.select("owner_id", F.to_date("start").alias("date"), round_display(F.col("kcal"), 6).alias("kcal"))
