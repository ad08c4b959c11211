"""Periodic runs of words: stretches that repeat with a short period, and texts without the repeats.

A run of period ``q`` and length ``L`` has ``L - q`` pairs of equal words ``q`` apart, one after
another.  So a text is searched in two steps.

1. *Count.*  For every lag, how many words equal the word that far after them.  Words are counted
   apart, each the cheaper way: a frequent word (heavy) by the autocorrelation of the places it
   stands at, with a fast Fourier transform whose results are rounded to the integers they are; a
   rare one (light) by the differences of all pairs of its places.
2. *Scan.*  Only lags with enough matches for a run are looked at.  A run's island of matches is so
   long that several of the evenly spaced probes of the lag fall into it, one after another, so
   only what lies around such probes is compared word by word.

Lags are taken from small to large.  A stretch of period ``p`` matches at all multiples of ``p`` too;
those matches are known from the run found first, so they're taken off the counts and never scanned.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, table, utf8

#: Shortest run, in words, and least number of times that its period fits into it.
LEAST, TIMES = 6, 4
#: Probes that an island of the least length holds at least.
PROBES = 8
#: Pairs of places that are counted at once.
PAIRS = 1 << 20
BLANK = r"[\x20\x09-\x0D]"
RUN = "struct<start: long, length: long, period: long>"


def _need(lag: int) -> int:
    """Matches of a lag in a row that make a run."""
    return max(LEAST, TIMES * lag) - lag


def count_matches(words: np.ndarray) -> np.ndarray:
    """For each lag up to a quarter of the text, how many of ``words`` (numbers from 0) equal the one that far on."""
    n = len(words)
    most = n // TIMES
    counts = np.zeros(most + 1, np.int64)
    order = np.argsort(words, kind="stable")
    sizes = np.bincount(words)
    length = 1 << (n + most).bit_length()
    # A word of f places has up to f * f / 2 pairs; its transform takes n log n steps, each a tenth of a pair's time.
    heavy = sizes.astype(np.float64) ** 2 > length * np.log2(length) / 4
    ends = np.cumsum(sizes)
    if heavy.any():
        power = np.zeros(length // 2 + 1)
        for w in np.flatnonzero(heavy):
            mark = np.zeros(length)
            mark[order[ends[w] - sizes[w] : ends[w]]] = 1
            spectrum = np.fft.rfft(mark)
            power += spectrum.real**2 + spectrum.imag**2
        counts += np.rint(np.fft.irfft(power, length)[: most + 1]).astype(np.int64)
    places = order[~heavy[words[order]]]
    keys = words[places] * (n + most + 1) + places  # ascend; a word's places lie apart from the next word's
    partners = np.searchsorted(keys, keys + most, side="right") - np.arange(len(keys)) - 1
    before = np.r_[0, np.cumsum(partners)]
    first = 0
    while first < len(keys):  # bounded memory: so many pairs at a time, those of one place whole
        last = max(first + 1, int(np.searchsorted(before, before[first] + PAIRS, side="right")) - 1)
        left = np.repeat(np.arange(first, last), partners[first:last])
        right = left + 1 + np.arange(len(left)) - (before[left] - before[first])
        counts += np.bincount(places[right] - places[left], minlength=most + 1)
        first = last
    counts[0] = 0
    return counts


def _islands(words: np.ndarray, lag: int, low: int, high: int) -> Iterator[tuple[int, int]]:
    """Stretches ``[start, stop)`` within ``[low, high)`` of places that match ``lag`` on, if long enough for a run."""
    same = np.r_[False, words[low:high] == words[low + lag : high + lag], False]
    edges = np.flatnonzero(same[1:] != same[:-1])
    for start, stop in zip(edges[::2].tolist(), edges[1::2].tolist()):
        if stop - start >= _need(lag):
            yield low + start, low + stop


def find_runs(words: np.ndarray) -> list[tuple[int, int, int]]:
    """All runs ``(start, length, period)``, by start and period."""
    n = len(words)
    if n < LEAST:
        return []
    runs: list[tuple[int, int, int]] = []
    known: dict[int, list[tuple[int, int, int]]] = {}  # by the next multiple of its period, what a run matches there
    counts = count_matches(words)
    lags = np.arange(len(counts))
    for lag in np.flatnonzero((counts >= np.maximum(LEAST, TIMES * lags) - lags) & (lags > 0)).tolist():
        owned = known.pop(lag, [])
        for run in owned:
            if TIMES * (lag + run[2]) <= run[1]:
                known.setdefault(lag + run[2], []).append(run)
        need = _need(lag)
        if counts[lag] - sum(length - lag for _, length, _ in owned) < need:
            continue
        step = max(1, need // (PROBES + 1))
        probes = np.arange(0, n - lag, step)
        same = words[probes] == words[probes + lag]
        for start, length, _ in owned:
            same[-(-start // step) : -(-(start + length - lag) // step)] = False
        edges = np.flatnonzero(np.diff(np.r_[False, same, False].astype(np.int8)))
        for first, past in zip(edges[::2].tolist(), edges[1::2].tolist()):
            if past - first < min(PROBES, need):
                continue
            # An island holds no probe that differs and none of a known run, so it ends before those on either side.
            low, high = max(0, (first - 1) * step + 1), min(n - lag, past * step)
            for start, stop in _islands(words, lag, low, high):
                run = (start, stop - start + lag, lag)
                runs.append(run)
                if TIMES * 2 * lag <= run[1]:
                    known.setdefault(2 * lag, []).append(run)
    return sorted(runs, key=lambda r: (r[0], r[2]))


def kept_words(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """A mask of the words that no run holds after its first period."""
    kept = np.ones(n, bool)
    for start, length, period in runs:
        kept[start + period : start + length] = False
    return kept


def _found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
    for batch in batches:
        texts = batch.column("_text")
        n_words, runs, collapsed = [], [], []
        for text in texts:
            words = text.as_buffer().to_pybytes().split()
            ids: dict[bytes, int] = {}
            found = find_runs(np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, len(words)))
            if found:
                words_kept = [words[i] for i in np.flatnonzero(kept_words(len(words), found)).tolist()]
            n_words.append(len(words))
            runs.append([dict(zip(("start", "length", "period"), r)) for r in found])
            collapsed.append(b" ".join(words_kept if found else words).decode())
        names = [n for n in batch.schema.names if n != "_text"]
        columns = [*(batch.column(n) for n in names), pa.array(n_words, pa.int64()), pa.array(runs, kinds), pa.array(collapsed, pa.string())]
        yield pa.RecordBatch.from_arrays(columns, names=[*names, "n_words", "runs", "collapsed"])


def periodic_runs(docs: DataFrame) -> DataFrame:
    """``doc_id, n_words, runs, collapsed`` of each row of ``docs(doc_id, text)``.

    ``runs`` lists every run as ``start, length, period`` in words, by start, then period; ``collapsed`` is
    the text without what a run repeats after its first period, words joined by one space.  Words are
    compared as they are, with their case.

    Null and empty texts have no words, no runs and an empty ``collapsed``.  Very long texts are searched
    whole: memory is some forty bytes a word, and a text is one row.  Runs that overlap are all listed.  Repeated rows and
    null ids keep their rows, an empty table gives an empty result, and extra columns are ignored.
    No row meets another: nothing is shuffled.
    """
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), utf8("text").alias("_text"))
    return rows.mapInArrow(_found, f"doc_id long, n_words long, runs array<{RUN}>, collapsed string")


def longest(runs: Column) -> Column:
    """The run of greatest length; of ties that of the smallest start, then period."""
    return F.get(F.array_sort(F.transform(runs, lambda r: F.struct((-r["length"]).alias("_l"), r["start"].alias("start"), r["period"].alias("period"), r["length"].alias("length")))), F.lit(0))


def planted(docs: DataFrame) -> DataFrame:
    """``docs(doc_id, text)`` of which some get words that repeat from a place on, as the query's contract says.

    Rows without an id, and those without words, stay as they are.
    """
    words = F.filter(F.split("text", f"{BLANK}+"), lambda w: w != "")
    rows = docs.select("doc_id", "text", F.crc32(F.col("doc_id").cast("string")).alias("_h"))
    rows = rows.select("doc_id", "text", F.expr("_h div 10").alias("_g"), F.when(F.col("_h") % 10 == 0, words).alias("_w"))
    rows = rows.withColumn("_n", F.nullif(F.array_size("_w"), F.lit(0)))
    rows = rows.withColumn("_a", (F.col("_g") % F.col("_n")).cast("int"))
    rows = rows.withColumn("_p", F.expr("1 + cast((_n - _a) div (3 + _g % 8) as int)"))
    again = F.transform(F.sequence(F.lit(0), F.col("_n") - 1), lambda i: F.get("_w", F.when(i < F.col("_a"), i).otherwise(F.col("_a") + (i - F.col("_a")) % F.col("_p"))))
    return rows.select("doc_id", F.coalesce(F.array_join(again, " "), "text").alias("text"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The runs of every document, its longest one, and digests of all runs and of the collapsed text; see ``periodic_runs`` for the edge cases."""
    found = periodic_runs(planted(table(spark, sf_dir, "documents")))
    lines = F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n")))
    best = found.withColumn("_best", longest(F.col("runs")))
    return best.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("_best.start").alias("start"), F.col("_best.length").alias("length"), F.col("_best.period").alias("period"),
        F.floor(F.col("_best.length") * 1000 / F.col("_best.period")).cast("long").alias("exponent_milli"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
