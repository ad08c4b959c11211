"""Line dedup: repeated passages, found by winnowing over words.

A text is its words, lower-cased; lines only matter when words are deleted, so
that a passage is found wherever lines break it.  Each run of ``GRAM`` words
(half of ``LEAST_WORDS``) is hashed, and of the runs within each window of
``LEAST_WORDS`` words the smallest hash is selected.  Two texts that share a
passage of that many words share its windows and so the windows' minima:
fingerprints are guaranteed, and they depend on nothing but the passage.

1. *Select.*  A selected minimum is kept once for each position, with its stretch:
   the neighbouring windows that select it.  Fingerprints that occur more than once,
   and those whose stretches differ, are marked in two bitmaps; only marked ones go on.
2. *Join positions.*  Occurrences of a fingerprint with equal stretches are joined with a
   representative, the earliest of them.  All the others are repeated as a whole.
3. *Extend.*  Where a fingerprint's stretches differ, a passage begins or ends near it, or a
   text repeats itself.  There the representatives' windows are compared with each other, by
   digests of all their words, and each but the earliest of equal ones is repeated.  So a match
   is extended both ways, word by word, as far as it agrees with *any* earlier occurrence, not
   with the representative alone, and into the middle of lines.
4. *Delete.*  The words of repeated windows go, and lines that lose all their words.

No occurrence is paired with each other one, and equal stretches and windows are
aggregated before they are shuffled, so a passage that a third of all texts hold
is a few rows for each task.  Texts that lose nothing are never shuffled: those
that lose something are marked in a third bitmap.  The first two have ``PER_MARK`` bits for
each fingerprint to be marked, up to ``MOST_MARKS``, the third has a constant size; a
bit that stands for something else too costs rows that are compared or moved in
vain, but none is missed.  Stretches and windows are equal where two digests of
all their words are, 96 bits in all.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from itertools import chain
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bit, bounded_batches, may_be_in, numbered, table, utf8, word, written

LEAST_WORDS = 50
#: Bytes of text whose words are in memory at once.
PART = 1 << 20
#: Bits of the bitmaps for each fingerprint in them, and the least and most bits of one.
PER_MARK, LEAST_MARKS, MOST_MARKS = 128, 1 << 16, 1 << 29
#: Odd numbers to hash runs of words with, for the digest and the check.
_BASE, _CHECK = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
_WORD = re.compile(rb"\S+")


def _hasher(words: np.ndarray, base: int) -> Callable[[Any, Any], np.ndarray]:
    """A function that hashes runs of words, from places to places, over hashes of the words."""
    powers = np.cumprod(np.full(len(words), base, np.uint64))
    sums = np.r_[np.uint64(0), np.cumsum(words * powers, dtype=np.uint64)]
    inverses = np.cumprod(np.full(len(words) + 1, pow(base, -1, 1 << 64), np.uint64))

    def runs(starts: Any, stops: Any) -> np.ndarray:
        out = (sums[stops] - sums[starts]) * inverses[starts]
        out ^= out >> np.uint64(31)
        out *= np.uint64(0xBF58476D1CE4E5B9)
        return out ^ (out >> np.uint64(29))

    return runs


def _sliding(values: np.ndarray, n: int, pick: np.ufunc) -> np.ndarray:
    """The least or greatest of each ``n`` neighbours, by doubling."""
    size = 1
    while size * 2 <= n:
        values = pick(values[:-size], values[size:])
        size *= 2
    return pick(values[: len(values) - (n - size)], values[n - size :]) if size < n else values


class Passages:
    """The stretches of some texts: arrays of their text, first word, windows, fingerprint and digest."""

    def __init__(self, texts: list[bytes], least: int = LEAST_WORDS):
        split = [t.lower().split() for t in texts]
        counts = np.fromiter(map(len, split), np.int64, len(split))
        words = np.fromiter(map(xxhash.xxh64_intdigest, chain.from_iterable(split)), np.uint64, int(counts.sum()))
        gram = max(1, least // 2)
        self.near = near = least - gram + 1
        if len(words) < least:  # no window: as of a single text of so many words that isn't whole
            counts, words = np.zeros(1, np.int64), np.zeros(least, np.uint64)
        self.least, self._words, self._runs = least, words, _hasher(words, _BASE)
        self._grams = self._runs(slice(None, -gram), slice(gram, None))
        minima = _sliding(self._grams, near, np.minimum)
        stops = np.cumsum(counts)
        owner = np.repeat(np.arange(len(counts) + 1), np.r_[counts, least])[: len(minima)]
        self._whole = np.arange(len(minima)) + least <= np.r_[stops, 0][owner]  # not into the next text
        self._minima, whole = minima, np.flatnonzero(self._whole)
        fps, owner = minima[whole], owner[whole]
        first = np.flatnonzero(np.r_[True, (fps[1:] != fps[:-1]) | (owner[1:] != owner[:-1])][: len(fps)])
        # Only a text that repeats itself selects one minimum longer than it's near: such a stretch is cut.
        since = np.arange(len(fps)) - np.repeat(first, np.diff(np.r_[first, len(fps)]))
        first = np.flatnonzero(since % near == 0)
        self.sizes = np.diff(np.r_[first, len(fps)])
        self.owner, self.fps, self._start, self._text = owner[first], fps[first], whole[first], stops - counts
        self.digests = self._runs(self._start, self._start + self.sizes - 1 + least)
        self.at = self._start - self._text[self.owner]

    def periodic(self) -> np.ndarray:
        """Fingerprints that stand near themselves: windows of one stretch may be equal."""
        edge = np.zeros(self.near - 1, np.uint64)
        # A run is selected where it is the minimum of one of the windows around it.
        most = _sliding(np.r_[edge, np.where(self._whole, self._minima, np.uint64(0)), edge], self.near, np.maximum)
        places = np.flatnonzero(most == self._grams)
        order = places[np.argsort(self._grams[places], kind="stable")]
        fps = self._grams[order]
        return np.unique(fps[1:][(fps[1:] == fps[:-1]) & (np.diff(order) <= self.near)])

    def checked(self, shared: np.ndarray, differ: np.ndarray) -> list[pa.Array]:
        """Of the stretches in the mask ``shared``: the digest, check, and those of each window where ``differ``, null elsewhere.

        A check is of other values of the words and has another base, so that it tells apart what one digest takes for equal.
        """
        checks = _hasher((self._words ^ (self._words >> np.uint64(32))) * np.uint64(_CHECK), _CHECK)
        start, sizes, differ = self._start[shared], self.sizes[shared], differ[shared]
        stop = start + sizes - 1 + self.least
        sizes = np.where(differ, sizes, 0)
        step = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        window = np.repeat(start, sizes) + step
        offsets, mask = pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32)), pa.array(~differ)
        pairs = [(self._runs(a, b).view(np.int64), (checks(a, b) >> np.uint64(32)).astype(np.uint32).view(np.int32)) for a, b in ((start, stop), (window, window + self.least))]
        return [*map(pa.array, pairs[0]), *(pa.ListArray.from_arrays(offsets, pa.array(x), mask=mask) for x in pairs[1])]


def without_words(text: bytes, spans: list[tuple[int, int]]) -> tuple[bytes, int]:
    """The text without the words of the spans (first, how many), and how many lines lost all words."""
    lines = text.split(b"\n")
    counts = [len(x.split()) for x in lines]
    if not spans:
        return text, 0
    change = np.zeros(sum(counts) + 1, np.int64)
    first, size = np.array(spans).T
    np.add.at(change, first, 1)
    np.add.at(change, first + size, -1)
    gone = (np.cumsum(change) > 0).tolist()
    kept, at = [], 0
    for line, n in zip(lines, counts):
        cut = gone[at : at + n]
        at += n
        if not any(cut):
            kept.append(line)
        elif not all(cut):
            kept.append(_without(line, cut))
    return b"\n".join(kept), len(lines) - len(kept)


def _without(line: bytes, cut: list[bool]) -> bytes:
    """The line without the words to be cut and the blanks after them; at its end, before them."""
    spans = [m.span() for m in _WORD.finditer(line)]
    last = max(k for k, c in enumerate(cut) if not c)
    stops = [a for a, _ in spans[1 : last + 1]] + [spans[last][1]]
    tail = line[spans[-1][1] :] if last < len(cut) - 1 else line[spans[last][1] :]
    return line[: spans[0][0]] + b"".join(line[a:stop] for (a, _), stop, c in zip(spans, stops, cut) if not c) + tail


def _parts(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[tuple[pa.RecordBatch, Passages]]:
    """Slices of the batches of about ``PART`` bytes of text, or of one text, and their stretches."""
    for batch in batches:
        sizes = pc.binary_length(batch.column("_text")).to_numpy(zero_copy_only=False)
        edges = np.flatnonzero(np.diff(np.cumsum(sizes) // PART, prepend=-1)).tolist()
        for start, stop in zip(edges, [*edges[1:], len(sizes)]):
            part = batch.slice(start, stop - start)
            yield part, Passages([t.as_buffer().to_pybytes() for t in part.column("_text")], least)


def _stretches(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """Each stretch; and two that differ for a fingerprint that stands near itself."""
    for _, found in _parts(batches, least):
        periodic = found.periodic()
        n = len(periodic)
        fps = np.r_[found.fps, periodic, periodic]
        digests = np.r_[found.digests, np.zeros(n, np.uint64), np.ones(n, np.uint64)]
        yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in (fps, digests)], names=["fp", "stretch"])


_FOUND = "doc_id long, tkey long, at long, stretch long, check int, windows array<long>, checks array<int>, size int"


def _marked(batches: Iterator[pa.RecordBatch], least: int, marks: Broadcast) -> Iterator[pa.RecordBatch]:
    """Marked stretches, with the digests of their windows where the fingerprint's stretches differ."""
    mask = np.uint64(marks.value.shape[1] * 64 - 1)
    for batch, found in _parts(batches, least):
        bits = found.fps & mask
        shared, differ = (marks.value[:, (bits >> np.uint64(6)).astype(np.int64)] >> (bits & np.uint64(63)) & np.uint64(1)).astype(bool)
        rows = pa.array(found.owner[shared])
        columns = [pa.array(found.at[shared]), *found.checked(shared, differ), pa.array(found.sizes[shared].astype(np.int32))]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(rows), batch.column("tkey").take(rows), *columns], names=["doc_id", "tkey", "at", "stretch", "check", "windows", "checks", "size"])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, gone = [], []
        for text, spans in zip(batch.column("_text"), batch.column("_spans").to_pylist()):
            new, n = without_words(text.as_buffer().to_pybytes(), [(s >> 32, s & 0xFFFFFFFF) for s in spans])
            texts.append(new.decode())
            gone.append(n)
        names = [n for n in batch.schema.names if n not in ("_text", "_spans")]
        yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(texts, pa.string()), pa.array(gone, pa.int64())], names=[*names, "_new", "_gone"])


def _marks(stretches: DataFrame) -> np.ndarray:
    """Bitmaps of the fingerprints (by their lowest bits) of more than one stretch, and of stretches that differ."""
    found = stretches.groupBy("fp").agg(F.count("*").alias("n"), (F.min("stretch") < F.max("stretch")).alias("differ")).where("n > 1")
    found = found.groupBy(word("fp", MOST_MARKS).alias("at")).agg(F.bit_or(bit("fp")).alias("shared"), F.bit_or(F.when(F.col("differ"), bit("fp")).otherwise(0)).alias("differ"))
    words = found.toArrow()
    # Their bits count them, for the size: some that fall together don't matter to it.
    many = int(np.bitwise_count(words["shared"].to_numpy().view(np.uint64)).sum(dtype=np.int64))
    bits = min(MOST_MARKS, max(LEAST_MARKS, 1 << (PER_MARK * many - 1).bit_length()))
    marks = np.zeros((2, bits >> 6), np.uint64)
    at = words["at"].to_numpy() & ((bits >> 6) - 1)  # of the largest bitmap's words, those of this one fall together
    for k, name in enumerate(("shared", "differ")):
        np.bitwise_or.at(marks[k], at, words[name].to_numpy().view(np.uint64))
    return marks


def repeated_windows(docs: DataFrame, least: int = LEAST_WORDS) -> DataFrame:
    """``doc_id, tkey, span``: windows and stretches with an earlier occurrence, as first word * 2**32 + words.

    Earlier is by doc_id, then by word.  ``tkey`` tells texts of one doc_id apart.
    """
    bounded_batches(docs.sparkSession)
    rows = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("tkey"), utf8("text").alias("_text"))
    marks = docs.sparkSession.sparkContext.broadcast(_marks(rows.select("_text").mapInArrow(lambda b: _stretches(b, least), "fp long, stretch long")))
    found = written(rows.mapInArrow(lambda b: _marked(b, least, marks), _FOUND), "stretches")
    place = F.struct("doc_id", "tkey", "at")
    span = lambda words: (F.shiftleft("at", 32).bitwiseOR(words)).alias("span")

    def later(rows: DataFrame, *by: str) -> DataFrame:
        """The rows that aren't the earliest of those alike."""
        first = rows.groupBy(*by).agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
        return rows.join(first, list(by)).where(place != F.col("first"))

    whole = later(found.drop("windows", "checks"), "stretch", "check").select("doc_id", "tkey", span((F.col("size") + (least - 1)).cast("long")))
    ends = found.where("windows is not null").groupBy("stretch", "check").agg(F.min(F.struct("doc_id", "tkey", "at", "windows", "checks")).alias("first")).select("first.*")
    ends = ends.select("doc_id", "tkey", "at", F.posexplode(F.arrays_zip("windows", "checks")).alias("step", "window"))
    ends = ends.select("doc_id", "tkey", (F.col("at") + F.col("step")).alias("at"), "window.*")
    return whole.unionByName(later(ends, "windows", "checks").select("doc_id", "tkey", span(F.lit(least).cast("long"))))


def dedup_lines(docs: DataFrame, least: int = LEAST_WORDS) -> DataFrame:
    """``docs`` with later repeats of passages of at least ``least`` words deleted, and ``lines_deleted`` as the last column.

    A passage may begin and end within a line, and lines may break it elsewhere
    in each text.  A line that is repeated in part keeps its other words and
    isn't counted as deleted.
    Every row stays, if with an empty text where all of it has stood before;
    ``n_chars``, where there is one, follows the text.  Shorter repeats stay.
    Of equal passages the one of the smallest doc_id stays (ties, of one doc_id
    with different texts: of the smallest hash of the text).  Null texts and rows without doc_id
    stay as they are; rows that repeat both doc_id and text count as one document.
    In a text that repeats itself, occurrences may overlap: each word that a later
    occurrence covers goes.  Very long texts are read whole; a task holds some 200
    bytes for each word of ``PART`` bytes of texts, or of one text.  An empty table
    gives an empty result.  Extra columns are kept, whatever their names.
    """
    columns = docs.columns
    names = [c if c in ("doc_id", "text", "n_chars") else f"_keep{i}" for i, c in enumerate(columns)]
    docs = docs.toDF(*names)
    # A set, as rows that are alike say the same: a doc_id that is everywhere gathers no more than one text's spans.
    spans = repeated_windows(docs, least).groupBy("doc_id", "tkey").agg(F.collect_set("span").alias("_spans"))
    spans = written(spans.select(F.col("doc_id").alias("_doc"), F.col("tkey").alias("_tkey"), "_spans"), "spans")
    own = F.xxhash64("text")
    marked, found = may_be_in(docs, F.xxhash64(F.col("doc_id").cast("long"), own), spans.select(F.xxhash64("_doc", "_tkey").alias("_h")))
    hit = found & F.col("text").isNotNull()
    unchanged = marked.where(~hit).select(*names, F.lit(0).cast("long").alias("_gone"))
    held = marked.where(hit).select(*names).join(spans.hint("merge"), (F.col("doc_id").cast("long") == F.col("_doc")) & (own == F.col("_tkey")), "left")
    others = [n for n in names if n != "text"]
    fields = [f"`{n}` {docs.schema[n].dataType.simpleString()}" for n in others]
    rows = held.select(*others, F.col("_spans").isNotNull().alias("_less"), utf8("text").alias("_text"), F.coalesce("_spans", F.array().cast("array<long>")).alias("_spans"))
    cut = rows.mapInArrow(_cut, ", ".join([*fields, "_less boolean", "_new string", "_gone long"])).withColumnRenamed("_new", "text")
    if "n_chars" in names:
        cut = cut.withColumn("n_chars", F.when(F.col("_less"), F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return unchanged.unionByName(cut.select(*names, "_gone")).toDF(*columns, "lines_deleted")


def without_repeats(docs: DataFrame, least: int = LEAST_WORDS) -> DataFrame:
    """As ``dedup_lines``, with the columns of ``docs`` alone, whatever their names."""
    out = dedup_lines(docs, least)
    return out.toDF(*numbered(out.columns)).select(*numbered(docs.columns)).toDF(*docs.columns)


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: lines deleted, and words and SHA-256 of the text that is left."""
    left = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return left.select("doc_id", "lines_deleted", F.length("text").cast("long").alias("chars_left"), F.sha2(F.col("text").cast("binary"), 256).alias("text_digest"))
