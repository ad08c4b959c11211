"""Quality by nearest-neighbour voting over latent-semantic vectors.

Fitting: a bounded sample of labelled documents becomes term vectors (hashed
words, word shapes, and repeats at short distances; each group of terms has
unit length under the square root of its frequencies), weighted by inverse
document frequency and reduced by a truncated SVD.  Scoring: the labelled
vectors, the projection and the weights are broadcast (their size is a
product of constants), each block of documents is multiplied with all of them,
and the ``NEIGHBOURS`` with the largest cosine vote with their labels, weighted
by a power of the cosine.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, numbered, table, utf8

#: Labelled documents in the sample, those with the smallest hashes of doc_id: a bound on what is broadcast.
SAMPLE = 6000
DIMENSIONS = 32
NEIGHBOURS = 25
POWER = 8
THRESHOLD = 0.7
#: Hashed terms of each group: words, shapes.
WORD_TERMS, SHAPE_TERMS = 512, 512
#: Distances at which a word that comes again counts as a repeat.
LAGS = (1, 2, 3, 4, 5)
TERMS = WORD_TERMS + SHAPE_TERMS + 2 * len(LAGS) + 2
#: What the groups of terms weigh in a vector.
GROUP_WEIGHTS = (0.25, 1.0, 1.0)
#: Documents that are compared with the sample at once.
BLOCK = 64
_LETTERS, _DIGIT = re.compile(r"[^\W\d_]+"), re.compile(r"\d+")


def _shape(word: str) -> int:
    """The hashed shape of a word: runs of letters and digits become one sign, the rest stays."""
    upper = "" if word == word.lower() else "U" if word == word.upper() and len(word) > 2 else "T" if word[:1] != word[:1].lower() else "M"
    rest = "a" if word.isalpha() else _DIGIT.sub("9", _LETTERS.sub("a", word))
    return zlib.crc32((upper + rest).encode()) % SHAPE_TERMS


class _Cache(dict):
    """Term numbers of words seen, bounded: the word's times ``SHAPE_TERMS``, and the shape's."""

    def __missing__(self, word: str) -> int:
        found = zlib.crc32(word.lower().encode()) % WORD_TERMS * SHAPE_TERMS + _shape(word)
        if len(self) < 100_000 and len(word) < 40:
            self[word] = found
        return found


_cache = _Cache()


def term_vector(text: str) -> np.ndarray:
    """A text's terms, before weighting."""
    out = np.zeros(TERMS, np.float32)
    words = text.split()
    if not words:
        return out
    counts = dict.fromkeys(words)
    n, number = len(words), dict(zip(counts, range(len(counts))))
    text_ = np.fromiter(map(number.__getitem__, words), np.int64, n)
    pairs = np.fromiter(map(_cache.__getitem__, counts), np.int64, len(counts))[text_]
    out[:WORD_TERMS] = np.sqrt(np.bincount(pairs // SHAPE_TERMS, minlength=WORD_TERMS) / n)
    out[WORD_TERMS : WORD_TERMS + SHAPE_TERMS] = np.sqrt(np.bincount(pairs % SHAPE_TERMS, minlength=SHAPE_TERMS) / n)
    at = WORD_TERMS + SHAPE_TERMS
    for k, lag in enumerate(LAGS):
        share = np.count_nonzero(text_[lag:] == text_[:-lag]) / n
        out[at + 2 * k], out[at + 2 * k + 1] = np.sqrt(share), np.sqrt(1 - share) / len(LAGS)
    rare = n - len(counts)
    out[-2], out[-1] = rare / n / (1 + np.log(n)), 1 / (1 + np.log(n)) / 4
    for group, weight in zip((slice(0, WORD_TERMS), slice(WORD_TERMS, at), slice(at, TERMS)), GROUP_WEIGHTS):
        out[group] *= weight
    return out


@dataclass
class Model:
    """``TERMS`` x ``DIMENSIONS`` and ``SAMPLE`` x ``DIMENSIONS`` numbers at most."""

    projection: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    prior: float

    def embed(self, terms: np.ndarray) -> np.ndarray:
        latent = terms.astype(np.float64) @ self.projection
        return latent / np.maximum(np.linalg.norm(latent, axis=1, keepdims=True), 1e-12)

    def score(self, terms: np.ndarray, neighbours: int = NEIGHBOURS) -> np.ndarray:
        """The weighted votes for label 1; the prior where a text has no terms or there are no labels."""
        out = np.full(len(terms), self.prior)
        if not len(self.vectors):
            return out
        k = min(neighbours, len(self.vectors))
        for at in range(0, len(terms), BLOCK):
            block = terms[at : at + BLOCK]
            some = np.flatnonzero(block.any(axis=1))
            cosines = np.round(self.embed(block[some]) @ self.vectors.T, 9)
            near = np.argpartition(-cosines, k - 1, axis=1)[:, :k]
            best = np.take_along_axis(cosines, near, axis=1)
            labels, last = self.labels[near], best.min(axis=1, keepdims=True)
            # Of equal cosines some are in and some are out: those that are in vote with the mean of all of them.
            alike, tied = cosines == last, best == last
            for row in np.flatnonzero(alike.sum(axis=1) > tied.sum(axis=1)):
                labels[row, tied[row]] = self.labels[alike[row]].mean()
            votes = np.maximum(best, 0) ** POWER + 1e-9
            order = np.argsort(best, axis=1, kind="stable")
            votes, labels = np.take_along_axis(votes, order, axis=1), np.take_along_axis(labels, order, axis=1)
            out[at + some] = (votes * labels).sum(axis=1) / votes.sum(axis=1)
        return np.round(np.clip(out, 0.0, 1.0), 9)


def inverse_frequencies(terms: np.ndarray) -> np.ndarray:
    return np.log((1 + len(terms)) / (1 + (terms > 0).sum(axis=0))) + 1


def fit(terms: np.ndarray, labels: np.ndarray, dimensions: int = DIMENSIONS) -> Model:
    """Inverse document frequencies, a truncated SVD (subspace iteration from a fixed start) and the sample's vectors."""
    if not len(labels):
        return Model(np.zeros((TERMS, 1)), np.zeros((0, 1)), np.zeros(0), 0.5)
    idf = inverse_frequencies(terms)
    weighted = terms * idf.astype(np.float32)
    basis = np.random.default_rng(7).standard_normal((terms.shape[1], min(dimensions, *terms.shape)), np.float32)
    for _ in range(6):
        basis, _ = np.linalg.qr(weighted.T @ (weighted @ basis))
    model = Model(idf[:, None] * basis, np.zeros((0, 1)), labels.astype(np.float64), float(labels.mean()))
    model.vectors = model.embed(terms)
    return model


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [term_vector(t.as_buffer().to_pybytes().decode()).tobytes() for t in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.binary())], names=["label", "terms"])


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Fit on at most ``sample`` labelled documents that are not held out.

    The order of the sample is that of hashes, so reruns give one model.
    Labels other than 0 and 1, and labels without a document, are left out; a
    doc_id that is labelled twice has its smallest label, one with several texts
    its smallest text.  What comes to the driver is ``TERMS`` numbers for each of
    the sample, however long its texts are.
    """
    bounded_batches(docs.sparkSession)
    known = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.min("quality").alias("label"))
    known = known.join(docs.select("doc_id").where("text is not null").distinct(), "doc_id", "left_semi")
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    texts = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id")  # SAMPLE rows of two numbers
    # One text for each labelled doc_id, so that there are no more than ``sample``, however often rows repeat.
    single = texts.where("text is not null").groupBy("doc_id").agg(F.min("label").cast("long").alias("label"), F.min("text").alias("text"))
    rows = single.orderBy("doc_id").select("label", utf8("text").alias("text"))
    found = rows.mapInArrow(_terms, "label long, terms binary").collect()
    terms = np.array([np.frombuffer(r["terms"], np.float32) for r in found]).reshape(-1, TERMS)
    return fit(terms, np.array([r["label"] for r in found], np.float64))


def _score(model, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column("_text")
        scores = [np.zeros(0)]
        for at in range(0, len(texts), BLOCK):
            block = [term_vector(t.as_buffer().to_pybytes().decode()) for t in texts.slice(at, BLOCK)]
            scores.append(model.value.score(np.array(block)))
        names = [n for n in batch.schema.names if n != "_text"]
        yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(np.concatenate(scores), pa.float64())], names=[*names, "score"])


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with a ``score`` in [0, 1] of its whole ``text``.

    A null or empty text has no terms and scores the labels' mean (0.5 without
    labels).  Neighbours with equal cosines at the last place share it, so scores
    don't depend on the order of the sample.  A text of any length becomes one vector
    of ``TERMS`` numbers, in memory of some 100 bytes a word.  Repeated rows score
    alike, an empty table gives an empty result, extra columns are kept, whatever
    their names; ``score`` is the last column.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast(model)
    names = numbered(docs.columns)
    rows = docs.toDF(*names).withColumn("_text", utf8(names[docs.columns.index("text")]))
    fields = [f"{n} {f.dataType.simpleString()}" for n, f in zip(names, docs.schema)]
    scored = rows.mapInArrow(lambda batches: _score(shared, batches), ", ".join([*fields, "score double"]))
    return scored.toDF(*docs.columns, "score")


def keep_good(docs: DataFrame, model: Model, least: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that score ``least`` or more, with its columns alone, whatever their names."""
    scored = score_documents(docs, model)
    names = numbered(scored.columns)
    return scored.toDF(*names).where(F.col(names[-1]) >= least).select(*names[:-1]).toDF(*docs.columns)


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's score and label; see ``train`` and ``score_documents`` for the edge cases."""
    docs = table(spark, sf_dir, "documents")
    model = train(docs, table(spark, sf_dir, "labels"))
    scored = score_documents(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
