"""Quality rules: a table of thresholds compiled into one projection.

The statistics and the verdict are built-in expressions over the text of a row:
no user functions, no shuffle.  A statistic is linear in the text or sorts its
3-word windows (by their 64-bit hashes), so very long texts are only long.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, table

#: Frequent function words of the languages at hand.
STOP_WORDS = (
    "the and of to in is that it was for on are as with his they be at this from or by have not but what all were when we there can an "
    "der die und das von zu mit den im sich des auf für ist dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei "
    "le la les de des du et un une est que qui dans pour par pas sur au avec ou en il ce se plus "
    "el los las del y que se por con una su para es al lo como más o pero sus"
).split()

#: (name, statistic, comparison, bound): a row fails a rule where the comparison holds.
#: Repeated words are the base rule's.  Statistics are columns of ``statistics``.
THRESHOLDS = (
    ("short_words", "mean_word_chars", "<", 2.0),
    ("long_words", "mean_word_chars", ">", 15.0),
    ("symbols", "symbol_ratio", ">", 0.1),
    ("few_stop_words", "stop_word_ratio", "<", 0.02),
    ("repeated_lines", "dup_line_ratio", ">", 0.35),  # short texts that are labelled good repeat one line of three
)
LEAST_WORDS, MOST_REPEATED_PERCENT = 50, 50


def _ratio(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))


def _windows(words: Column) -> Column:
    """The 3-word windows, as hash and place, sorted, so that equal ones are neighbours."""
    places = F.sequence(F.lit(0), F.size(words) - 3)
    each = F.transform(places, lambda i: F.struct(F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)).alias("w"), i.alias("i")))
    return F.when(F.size(words) > 3, F.sort_array(each))


def _repeated_places(windows: Column) -> Column:
    """Where the windows begin that the text has twice or more (null if it has no two windows)."""
    others = F.size(windows) - 1
    twice = F.zip_with(F.slice(windows, F.lit(1), others), F.slice(windows, F.lit(2), others), lambda a, b: F.when(a["w"] == b["w"], F.array(a["i"], b["i"])))
    return F.when(windows.isNotNull(), F.array_distinct(F.flatten(F.array_compact(twice))))


def _repeated_words(at: Column) -> Column:
    """How many words stand in windows that begin at these places: each marks its three."""
    marks = F.concat(at, F.transform(at, lambda i: i + 1), F.transform(at, lambda i: i + 2))
    return F.when(at.isNull() | (F.size(at) == 0), F.lit(0)).otherwise(F.size(F.array_distinct(marks)))


def statistics(docs: DataFrame) -> DataFrame:
    """``doc_id`` and the statistics of each row's text (null: no words)."""
    text = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    words = text.select("doc_id", "text", F.regexp_extract_all("text", F.lit(f"({WORD})"), F.lit(1)).alias("words"))
    windows = words.select("doc_id", "text", "words", _windows(F.col("words")).alias("windows"))
    windows = windows.select("doc_id", "text", "words", _repeated_places(F.col("windows")).alias("at"))
    lines = F.filter(F.split("text", "\n"), lambda line: line.rlike(WORD))
    counted = windows.select(
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.size(lines).cast("long").alias("n_lines"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        _repeated_words(F.col("at")).cast("long").alias("n_repeat_words"),
        F.size(F.filter("words", lambda word: F.lower(word).isin(*STOP_WORDS))).cast("long").alias("n_stop_words"),
    )
    return counted.withColumns(
        {
            "mean_word_chars": _ratio(F.col("word_chars"), F.col("n_words")),
            "symbol_ratio": _ratio(F.col("n_symbols"), F.col("n_words")),
            "stop_word_ratio": _ratio(F.col("n_stop_words"), F.col("n_words")),
            "dup_line_ratio": _ratio(F.col("n_dup_lines"), F.col("n_lines")),
        }
    )


def compile_rules(thresholds=THRESHOLDS) -> Column:
    """The names of the rules that a row of ``statistics`` fails, in the table's order."""
    compare = {"<": lambda a, b: a < b, ">": lambda a, b: a > b}
    return F.array_compact(F.array(*[F.when(compare[op](F.col(stat), F.lit(bound)), F.lit(name)) for name, stat, op, bound in thresholds], F.lit(None).cast("string")))


def apply_rules(docs: DataFrame, thresholds=THRESHOLDS) -> DataFrame:
    """Statistics, ``base_failed``, ``failed`` rules and ``kept`` of each row of ``docs(doc_id, text)``.

    A null text has no words and fails the base.  A text is judged whole, in memory
    that grows with its words (about 100 bytes each).  Repeated rows are judged each
    on its own, an empty table gives an empty result, extra columns are ignored.
    """
    base = (F.col("n_words") < LEAST_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MOST_REPEATED_PERCENT)
    judged = statistics(docs).withColumns({"base_failed": base, "failed": compile_rules(thresholds)})
    return judged.withColumn("kept", ~F.col("base_failed") & (F.size("failed") == 0))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics and verdict of every document; see ``apply_rules`` for the edge cases."""
    return apply_rules(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


_W = r"[^\x20\x09-\x0D]+"
OP5_SQL = rf"""
WITH t AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents
), w AS (
  SELECT r, doc_id, text, regexp_extract_all(text, '{_W}') AS words,
         list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{_W}')) AS lines FROM t
), g AS (
  SELECT r, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS gram
  FROM (SELECT r, words, unnest(range(1, greatest(len(words) - 1, 1))) AS i FROM w)
), k AS (
  SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, gram) AS n FROM g) WHERE n > 1
), c AS (
  SELECT r, CAST(count(DISTINCT p) AS BIGINT) AS n_repeat_words FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM k) GROUP BY r
), s AS (
  SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words,
         CAST(coalesce(list_sum(list_transform(words, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
         CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
         CAST(len(lines) AS BIGINT) AS n_lines,
         CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
         coalesce(n_repeat_words, 0) AS n_repeat_words,
         len(list_filter(words, lambda x: list_contains([{", ".join(repr(x) for x in STOP_WORDS)}], lower(x)))) AS n_stop
  FROM w LEFT JOIN c USING (r)
), b AS (
  SELECT *, (n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED_PERCENT} * n_words) AS base_failed FROM s
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       (NOT base_failed AND NOT (
         word_chars < 2.0 * n_words OR word_chars > 15.0 * n_words
         OR n_symbols / n_words > 0.1 OR n_stop / n_words < 0.02 OR n_dup_lines / n_lines > 0.35
       )) AS kept
FROM b
"""
