"""What the operators share: a shared work folder, written tables, batch limits."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but ASCII blanks.
WORD = r"[^\x20\x09-\x0D]+"


#: Folders that this process has made, by name: what ``remove_work`` clears.
_made: dict[str, SparkSession] = {}


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder that the driver and every executor see.

    It lies in ``spark.checkpoint.dir``.  Only a local session, as in tests, may
    leave that unset: a temporary folder is made and set.  On a cluster executors
    would write to their own disks, so there it is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="victual-")
        spark.sparkContext.setCheckpointDir(root)
    path = f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _made[path] = spark
    return path


def remove_work() -> int:
    """Delete the work folders made so far, and say how many there were.

    Results are lazy and read from these folders, so call it when they have
    been written elsewhere or aren't needed any more.
    """
    for path, spark in (gone := dict(_made)).items():
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
        del _made[path]
    return len(gone)


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write ``df`` to the shared folder and read it again."""
    spark = df.sparkSession
    path = shared_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bounded_batches(spark: SparkSession) -> None:
    """Keep what one Arrow batch holds small, however long the texts are.

    These are settings of the session, as Spark has none for a single operator;
    smaller ones that the caller has set are left alone.
    """
    for key, most in (("maxRecordsPerBatch", 2000), ("maxBytesPerBatch", 4 << 20)):
        key = f"spark.sql.execution.arrow.{key}"
        now = re.fullmatch(r"(\d+)b?", spark.conf.get(key))
        if now is None or not 0 < int(now[1]) <= most:
            spark.conf.set(key, str(most))


def numbered(columns: list[str]) -> list[str]:
    """Names for columns that clash with nothing, whatever those of the caller's table are."""
    return [f"_c{i}" for i in range(len(columns))]


def bit(of: str) -> Column:
    """The bit in its word that stands for a hash."""
    return F.expr(f"shiftleft(1L, cast({of} & 63 as int))")


def word(of: str, bits: int) -> Column:
    """Which word of a bitmap of so many bits a hash falls into."""
    return F.shiftright(F.col(of).bitwiseAND(F.lit(bits - 1)), 6).cast("int")


#: Bits of the bitmap of rows that need a join.
HOLDERS = 1 << 24


def may_be_in(rows: DataFrame, key: Column, keys: DataFrame) -> tuple[DataFrame, Column]:
    """``rows``, and a condition on them: false only where ``key`` is none of ``keys(_h)``, both hashes.

    A bitmap of ``HOLDERS`` bits is broadcast, at most ``HOLDERS / 64`` rows of it
    whatever there is to mark.  It tells which rows needn't be shuffled to be joined;
    a bit that stands for another hash too only costs the shuffle of a row.
    """
    bitmap = keys.groupBy(word("_h", HOLDERS).alias("_at")).agg(F.bit_or(bit("_h")).alias("_bits"))
    marked = rows.withColumn("_h", key).join(F.broadcast(bitmap), word("_h", HOLDERS) == F.col("_at"), "left")
    return marked, F.coalesce(F.col("_bits").bitwiseAND(bit("_h")) != 0, F.lit(False))


def utf8(column: str) -> Column:
    """The column's UTF-8 bytes, null as empty."""
    return F.coalesce(F.col(column).cast("binary"), F.lit(b""))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
