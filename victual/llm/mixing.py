"""Mixing sources to target weights, by Efraimidis-Spirakis sampling.

Every document gets an exponential key, divided by its quality weight.  A
source's target is spent on whole epochs first; the rest is spent in the order
of the keys until the words run out.  All of it is built-in expressions:
no Python touches a row.

No source is sorted in one place.  Keys fall into ``BUCKETS`` ranges; words are
summed by source and range, these sums are prefix-summed, and only the range
in which a source's budget runs out is looked at further.  While it holds over
``SORTED`` documents of some source it is split into as many ranges again, so
that keys that crowd, as those of low weights do, are no hot range; then it is
sorted by document.  What is joined back to the documents is one row for each source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, table, written

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST_EPOCHS = 2.0
BUCKETS = 4096
#: Documents of a source that are sorted in one task.
SORTED = 100_000
#: Source tables up to this many rows are broadcast; beyond that they are joined by shuffle.
BROADCAST_SOURCES = 50_000


def _size() -> Column:
    return F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("long")


def _key(seed: str) -> Column:
    """An exponential variable drawn from doc_id and seed, over the document's quality weight.

    The weight falls with the symbols among the words: clean prose weighs 1.
    """
    name = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("none")), F.lit(":" + seed))
    uniform = (F.conv(F.substring(F.md5(name.cast("binary")), 1, 13), 16, 10).cast("double") + 1.0) / float(1 << 52)
    symbols = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(r"[#*$%&|<>]")).cast("double")
    weight = F.lit(1.0) / (F.lit(1.0) + F.lit(4.0) * symbols / F.greatest(F.col("size"), F.lit(1)).cast("double"))
    return -F.ln(uniform) / weight


def _source_key(source: str = "source") -> Column:
    """Never null, and sorted by code point with null last."""
    return F.when(F.col(source).isNull(), "2").otherwise(F.concat(F.lit("1"), F.col(source).cast("string")))


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST_EPOCHS) -> DataFrame:
    """``skey, source_size`` -> with ``target``.

    Sources by code point weigh ``weights`` in turn.  A target is its weight's
    part of ``share`` of all words, but at most ``most`` times its source; what
    is over goes to the rest by weight, until none is above.  In order of
    size over weight the sources at their cap are a prefix, so prefix sums give
    the level at which the resharing ends.
    """
    everything = Window.partitionBy()
    ordered = sizes.withColumn("_n", F.row_number().over(everything.orderBy("skey")) - 1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("_n") % len(weights) + 1).cast("int"))
    cap = F.col("source_size").cast("double") * most
    rows = ordered.withColumn("_w", weight).withColumn("_cap", cap)
    before = everything.orderBy(F.col("_cap") / F.col("_w"), "skey").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns(
        {
            "_total": F.sum("source_size").over(everything).cast("double") * share,
            "_weights": F.sum("_w").over(everything),
            "_cap_before": F.coalesce(F.sum("_cap").over(before), F.lit(0.0)),
            "_w_before": F.coalesce(F.sum("_w").over(before), F.lit(0.0)),
        }
    )
    # The level if exactly the sources before this one are capped.  The first source that stays under its
    # cap then sets it; later ones do so too, at levels that only fall.
    level = (F.col("_total") - F.col("_cap_before")) / (F.col("_weights") - F.col("_w_before"))
    rows = rows.withColumn("_level", F.max(F.when(level * F.col("_w") <= F.col("_cap"), level)).over(everything))
    target = F.when(F.col("_level").isNull(), F.col("_cap")).otherwise(F.least("_cap", F.col("_level") * F.col("_w")))
    return rows.select("skey", "source_size", target.alias("target"))


def _slim(docs: DataFrame, seed: str) -> DataFrame:
    key = _key(seed)
    sized = docs.withColumn("size", _size()).withColumn("skey", _source_key())
    keyed = sized.select("doc_id", "skey", "size", key.alias("key"))
    # Keys of weight 1 are even in 1 - exp(-key); those of low weights crowd into the last ranges, see ``plan_mix``.
    bucket = F.least(F.floor((1.0 - F.exp(-F.col("key"))) * BUCKETS), F.lit(BUCKETS - 1)).cast("int")
    return keyed.withColumn("bucket", bucket)


def _ending(ranges: DataFrame, budgets: DataFrame) -> DataFrame:
    """Of ``ranges(skey, bucket, words, n, low, high)``, each source's in which its budget ends, and what is ``left`` of it there."""
    before = Window.partitionBy("skey").orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = ranges.withColumn("upto", F.sum("words").over(before)).join(budgets, "skey")
    return summed.where("budget > upto - words and budget <= upto").select("skey", "low", "high", "n", (F.col("budget") - (F.col("upto") - F.col("words"))).alias("left"))


def _joined(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """Rows with those of a written table of sources: broadcast if it has few rows."""
    if plan.count() <= BROADCAST_SOURCES:
        return rows.join(F.broadcast(plan), "skey")
    return rows.join(plan, "skey")


def _range() -> list[Column]:
    return [F.sum("size").alias("words"), F.count("*").alias("n"), F.min("key").alias("low"), F.max("key").alias("high")]


def plan_mix(slim: DataFrame, most: int = SORTED, **parameters) -> DataFrame:
    """One row for each source: its size, target, epochs, and where its fractional selection ends.

    ``slim`` has ``doc_id, skey, size, key, bucket``.  Documents before
    ``(end_key, end_doc, end_size)`` are taken once more; those at it, one
    document or rows that are alike in all three, take ``end_words`` each.
    """
    ranges = written(slim.groupBy("skey", "bucket").agg(*_range()), "ranges")
    sizes = ranges.groupBy("skey").agg(F.sum("words").alias("source_size"))
    goal = targets(sizes, **parameters)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    goal = goal.withColumn("epochs", epochs).withColumn("budget", F.round(F.col("target") - F.col("epochs") * F.col("source_size")).cast("long"))
    goal = written(goal, "targets")
    ending = written(_ending(ranges, goal.select("skey", "budget")), "ending")
    # Rows whose keys are one are alike and are counted, not sorted.
    while not ending.where((F.col("n") > most) & (F.col("low") < F.col("high"))).isEmpty():
        part = F.least(F.floor((F.col("key") - F.col("low")) / F.greatest(F.col("high") - F.col("low"), F.lit(1e-300)) * BUCKETS), F.lit(BUCKETS - 1)).cast("int")
        inside = _joined(slim.drop("bucket"), ending).where("key between low and high").select("skey", "size", "key", part.alias("bucket"))
        ending = written(_ending(inside.groupBy("skey", "bucket").agg(*_range()), ending.select("skey", F.col("left").alias("budget"))), "ending")
    groups = _joined(slim.drop("bucket"), ending).where("key between low and high").groupBy("skey", "left", "key", "doc_id", "size").agg(F.count("*").alias("n"))
    order = Window.partitionBy("skey").orderBy("key", F.col("doc_id").asc_nulls_last(), "size")
    placed = groups.withColumn("upto", F.sum(F.col("size") * F.col("n")).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    end = placed.where(F.col("left").between(F.col("upto") - F.col("size") * F.col("n") + 1, F.col("upto"))).select(
        "skey", F.col("key").alias("end_key"), F.col("doc_id").alias("end_doc"), F.col("size").alias("end_size"),
        F.floor((F.col("left") - (F.col("upto") - F.col("size") * F.col("n"))) / F.col("n")).cast("long").alias("end_words"),
    )
    return written(goal.join(end, "skey", "left"), "plan")


def _taken(docs_plan: DataFrame) -> DataFrame:
    """``taken`` words of each row that has its source's plan beside it."""
    same = F.col("key") == F.col("end_key")
    far = F.lit(1 << 62)
    mine, last = F.coalesce("doc_id", far), F.coalesce("end_doc", far)
    before = (F.col("key") < F.col("end_key")) | (same & ((mine < last) | ((mine == last) & (F.col("size") < F.col("end_size")))))
    at = same & (mine == last) & (F.col("size") == F.col("end_size"))
    part = F.when(F.col("end_key").isNull(), F.lit(0)).when(before, F.col("size")).when(at, F.col("end_words")).otherwise(F.lit(0))
    return docs_plan.withColumn("taken", (F.col("epochs") * F.col("size") + part).cast("long"))


def mix_sizes(docs: DataFrame, seed: str = "mix", **parameters) -> DataFrame:
    """``doc_id, size, source_size, target, taken`` of each row of ``docs(doc_id, text, source)``.

    Complete epochs precede the fractional selection, whose last document is
    taken in part, so a source's words meet its target to a word (to one word
    for each of rows that repeat that document).  A null text has no words; a
    null source is a source of its own, the last.  Rows without words are
    taken with 0; an empty table gives an empty result; extra columns are ignored.
    """
    slim = written(_slim(docs, seed), "keys")
    return _taken(_joined(slim, plan_mix(slim, **parameters))).select("doc_id", "size", "source_size", "target", "taken")


def mix_documents(docs: DataFrame, seed: str = "mix", **parameters) -> DataFrame:
    """The mix itself: a row of ``docs`` for each time it is taken, with its columns.

    The one document in which a source's budget ends is cut to its words, its
    blanks becoming single spaces.
    """
    columns, names = docs.columns, [f"_mix{i}" if c not in ("doc_id", "text", "source", "n_chars") else c for i, c in enumerate(docs.columns)]
    docs = docs.toDF(*names)  # no column clashes with those of the plan
    plan = plan_mix(written(_slim(docs, seed), "keys"), **parameters)
    rows = docs.withColumn("size", _size()).withColumn("skey", _source_key()).withColumn("key", _key(seed))
    taken = _taken(_joined(rows, plan)).where("taken > 0")
    words = F.greatest(F.col("size"), F.lit(1))  # a filter may run after what follows it
    whole, part = F.floor(F.col("taken") / words), F.col("taken") % words
    copies = taken.withColumn("_times", F.sequence(F.lit(1), (whole + F.when(part > 0, 1).otherwise(0)).cast("int")))
    copies = copies.withColumn("_whole", whole).withColumn("_part", part.cast("int")).withColumn("_time", F.explode("_times"))
    cut = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(f"({WORD})"), F.lit(1)), F.lit(1), F.greatest(F.col("_part"), F.lit(1))), " ")
    text = F.when(F.col("_time") <= F.col("_whole"), F.col("text")).otherwise(cut)
    out = copies.withColumn("text", text)
    if "n_chars" in columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*names).toDF(*columns)


def op10_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix takes of every document; see ``mix_sizes`` for the edge cases."""
    return mix_sizes(table(spark, sf_dir, "documents"))


OP10_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, CASE WHEN source IS NULL THEN '2' ELSE '1' || source END AS skey,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         len(regexp_extract_all(coalesce(text, ''), '[#*$%&|<>]'))::DOUBLE AS symbols,
         (('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'none') || ':mix'), 1, 13))::BIGINT::DOUBLE + 1.0) / 4503599627370496.0 AS u
  FROM documents
), k AS (
  SELECT doc_id, skey, size, -ln(u) / (1.0::DOUBLE / (1.0::DOUBLE + 4.0::DOUBLE * symbols / greatest(size, 1)::DOUBLE)) AS key FROM d
), s AS (
  SELECT skey, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY skey) - 1 AS n FROM k GROUP BY skey
), w AS (
  SELECT skey, source_size, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][(n % 3 + 1)::INTEGER] AS w, source_size::DOUBLE * 2.0::DOUBLE AS cap FROM s
), p AS (
  SELECT *, (sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE AS total, sum(w) OVER () AS weights,
         coalesce(sum(cap) OVER b, 0.0) AS cap_before, coalesce(sum(w) OVER b, 0.0) AS w_before
  FROM w WINDOW b AS (ORDER BY cap / w, skey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), l AS (
  SELECT *, max(CASE WHEN (total - cap_before) / (weights - w_before) * w <= cap THEN (total - cap_before) / (weights - w_before) END) OVER () AS level FROM p
), t AS (
  SELECT skey, source_size, CASE WHEN level IS NULL THEN cap ELSE least(cap, level * w) END AS target FROM l
), e AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS epochs FROM t
), b AS (
  SELECT *, CAST(round(target - epochs * source_size) AS BIGINT) AS budget FROM e
), o AS (
  SELECT k.doc_id, size, source_size, target, epochs, budget,
         coalesce(sum(size) OVER (PARTITION BY k.skey ORDER BY key, k.doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS upto
  FROM k JOIN b ON k.skey = b.skey
)
SELECT doc_id, size, source_size, target, CAST(epochs * size + greatest(0, least(size, budget - upto)) AS BIGINT) AS taken FROM o
"""
