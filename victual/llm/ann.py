"""Nearest neighbours by randomly rotated one-bit codes.

A vector, less the rows' mean and scaled to length one, is rotated at random
and keeps one bit for each component, packed into 64-bit words, and three
numbers: its length, the inner product of its code (as a unit vector) with
itself, and its product with the mean.  A query is rotated alike and its
components are rounded to ``PLANES`` bits; one plane of bits at a time, the
codes' bits are anded with it and counted.  Counts and numbers give an unbiased
estimate of an inner product, and the error is below
``EPSILON * sqrt((1 - c*c) / (c*c * (d - 1)))`` lengths, and what the rounding
adds at most, with a probability that ``EPSILON`` fixes.

Queries meet the rows in blocks: a task has one block of queries and one of
rows, of fixed sizes, so memory is bounded whatever the table's size.  There a
query's rows of the best estimates are computed exactly, in double precision;
the 20th best of these exact products is the cut, and rows whose upper bound
reaches it are reranked.  Each query's best of a block are merged by query.

Vectors travel with their codes: a block has so many queries that nearly every
row is some query's candidate, and a second join on the candidates of all
queries would move more (16 bytes a pair) than a copy of the block.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, written

TOP = 20
EPSILON = 1.5
PLANES = 8
#: Numbers in the vectors of rows, and of queries, that meet in one task: 8 and 16 MB, whatever their length.
ROWS, QUERIES = 1 << 20, 1 << 21
#: Rows of one table may have so many different lengths; each is searched on its own.
LENGTHS = 64
SEED = 11


def rotation(dimension: int, seed: int = SEED) -> np.ndarray:
    """A random orthogonal matrix, the same in every process."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dimension, dimension)))
    return q * np.sign(np.diag(r))


def words(bits: np.ndarray) -> np.ndarray:
    """Rows of bits, packed into 64-bit words."""
    packed = np.packbits(bits, axis=-1)
    space = -packed.shape[-1] % 8
    return np.ascontiguousarray(np.pad(packed, [(0, 0)] * (packed.ndim - 1) + [(0, space)])).view(np.uint64)


def encode(vectors: np.ndarray, mean: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's packed bits, and its length, correction and product with the mean."""
    rest = vectors - mean
    length = np.linalg.norm(rest, axis=1)
    turned = (rest / np.where(length > 0, length, 1)[:, None]) @ turn
    correction = np.abs(turned).sum(axis=1) / math.sqrt(vectors.shape[1])
    return words(turned > 0), np.stack([length, correction, vectors @ mean], axis=1)


def estimate(queries: np.ndarray, codes: np.ndarray, numbers: np.ndarray, mean: np.ndarray, turn: np.ndarray, epsilon: float = EPSILON) -> tuple[np.ndarray, np.ndarray]:
    """Estimated inner products of each query with each coded row, and their error bounds, in single precision."""
    d = len(mean)
    length, correction, with_mean = numbers.T
    rest = queries - mean
    turned = rest @ turn
    low, high = turned.min(axis=1, keepdims=True), turned.max(axis=1, keepdims=True)
    step = np.where(high > low, high - low, 1) / (2**PLANES - 1)
    rounded = np.rint((turned - low) / step).astype(np.uint16)
    planes = words(rounded[:, None, :] >> np.arange(PLANES, dtype=np.uint16)[:, None] & 1)  # queries, planes, words
    counts = np.zeros((len(queries), len(codes)), np.float32)
    for k in range(PLANES):
        for w in range(codes.shape[1]):
            counts += np.bitwise_count(planes[:, k, w, None] & codes[None, :, w]).astype(np.float32) * np.float32(2**k)
    ones = np.bitwise_count(codes).sum(axis=1, dtype=np.float64)
    # The sum of a query's rounded components, each with the sign that a bit of the code stands for.
    signed = (low * (2 * ones - d)[None, :] - step * rounded.sum(axis=1, keepdims=True)).astype(np.float32) + (2 * step).astype(np.float32) * counts
    safe = np.where(correction > 0, correction, 1)
    scale = length / safe / math.sqrt(d)
    products = signed * scale.astype(np.float32) + with_mean.astype(np.float32) + (rest @ mean)[:, None].astype(np.float32)
    spread = epsilon * np.sqrt(np.maximum(1 - safe**2, 0) / safe**2 / max(d - 1, 1)) * length
    error = np.linalg.norm(rest, axis=1)[:, None].astype(np.float32) * spread.astype(np.float32) + (step / 2 * d).astype(np.float32) * scale.astype(np.float32)
    return products, error + 1e-5 * (1 + np.abs(products))


def search_block(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray, codes, numbers, mean, turn, top: int = TOP) -> tuple[list[tuple[int, np.ndarray, np.ndarray]], int]:
    """Each query's number, best rows of a block and exact products, ties to the smaller id; and how many were reranked."""
    out, reranked = [], 0
    for at in range(0, len(queries), 64):
        part, part_ids = queries[at : at + 64], query_ids[at : at + 64]
        guess, error = estimate(part, codes, numbers, mean, turn)
        guess[part_ids[:, None] == ids[None, :]] = -np.inf
        few = min(2 * top, len(ids))
        first = np.argpartition(-guess, few - 1, axis=1)[:, :few]
        upper = guess + error
        for i, query in enumerate(part):
            exact = (vectors[first[i]] * query).sum(axis=1)
            exact[np.isneginf(guess[i, first[i]])] = -np.inf
            floor = -np.partition(-exact, top - 1)[top - 1] if len(exact) >= top else -np.inf
            near = np.flatnonzero((upper[i] >= floor) & (guess[i] > -np.inf))
            near = np.union1d(near, first[i][exact > -np.inf])
            reranked += len(near)
            exact = (vectors[near] * query).sum(axis=1)  # row by row alike: equal vectors score equally
            best = np.lexsort((ids[near], -exact))[:top]
            out.append((at + i, near[best], exact[best]))
    return out, reranked


def usable(rows: DataFrame) -> DataFrame:
    """``vec_id, embedding`` (doubles) of the rows that take part."""
    vector = F.col("embedding").cast("array<double>")
    good = F.exists("embedding", lambda x: x != 0) & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return rows.where("vec_id is not null").select(F.col("vec_id").cast("long").alias("vec_id"), vector.alias("embedding")).where(good)


def build_index(rows: DataFrame) -> tuple[DataFrame, dict[int, tuple[int, np.ndarray]]]:
    """The coded rows (all of them), and by length how many there are and their mean."""
    valid = usable(rows).withColumn("d", F.size("embedding"))
    most = valid.agg(F.max("d")).first()[0] or 0
    sums = valid.groupBy("d").agg(F.count("*").alias("n"), *[F.avg(F.get("embedding", F.lit(i))).alias(f"m{i}") for i in range(most)])
    found = sums.limit(LENGTHS + 1).collect()
    if len(found) > LENGTHS:
        raise ValueError(f"vectors have more than {LENGTHS} different lengths")
    means = {r["d"]: (r["n"], np.array(r[2 : 2 + r["d"]], np.float64)) for r in found}

    def coded(frames):
        for frame in frames:
            parts = []
            for d, part in frame.groupby("d"):
                codes, numbers = encode(np.stack(part["embedding"]), means[d][1], rotation(d))
                parts.append(part.assign(codes=[c.tobytes() for c in codes], numbers=list(numbers)))
            if parts:
                yield pd.concat(parts)

    index = valid.mapInPandas(coded, "vec_id long, embedding array<double>, d int, codes binary, numbers array<double>")
    return written(index, "codes"), means


def search(rows: DataFrame, is_query, top: int = TOP) -> DataFrame:
    """``query_id, rank, vec_id, score`` of the ``top`` nearest other rows of each row that ``is_query``.

    Vectors that are null, zero or hold null or non-finite components take no
    part, nor do rows without vec_id.  Vectors of each length are searched on their
    own, as products of others aren't defined; over ``LENGTHS`` lengths are an error.
    A query's own row is left out by its id, so rows that repeat an id aren't each
    other's neighbours; as neighbours of others each takes a place.  A query that
    is repeated with the same vector is answered once, with another vector each time.
    An empty table gives an empty result; extra columns are ignored.
    """
    index, means = build_index(rows)
    own = F.xxhash64("vec_id", "embedding").alias("own")
    questions = index.where(is_query).select("vec_id", "embedding", "d", own).dropDuplicates(["vec_id", "embedding"])
    asked = {r["d"]: r["count"] for r in questions.groupBy("d").count().collect()}
    blocks = lambda sizes, size: F.coalesce(F.element_at(F.create_map(*[F.lit(x) for d, n in sizes.items() for x in (d, max(1, math.ceil(n / max(1, size // d))))]), F.col("d")), F.lit(1)) if sizes else F.lit(1)
    row_blocks, query_blocks = blocks({d: n for d, (n, _) in means.items()}, ROWS), blocks(asked, QUERIES)
    block = lambda k: F.pmod(F.xxhash64("vec_id"), k).cast("int")
    each = lambda k: F.explode(F.sequence(F.lit(0), k - 1))
    left = questions.select("d", block(query_blocks).alias("q"), each(row_blocks).alias("r"), "vec_id", "own", "embedding")
    right = index.select("d", block(row_blocks).alias("r"), each(query_blocks).alias("q"), "vec_id", "embedding", "codes", "numbers")

    def best(asked: pd.DataFrame, there: pd.DataFrame) -> pd.DataFrame:
        if not len(asked) or not len(there):
            return pd.DataFrame({"query_id": [], "own": [], "vec_id": [], "score": []})
        _, mean = means[int(asked["d"].iloc[0])]
        codes = np.frombuffer(b"".join(there["codes"]), np.uint64).reshape(len(there), -1)
        ids, query_ids, owns = (x.to_numpy() for x in (there["vec_id"], asked["vec_id"], asked["own"]))
        found, _ = search_block(query_ids, np.stack(asked["embedding"]), ids, np.stack(there["embedding"]), codes, np.stack(there["numbers"]), mean, rotation(len(mean)), top)
        of = np.repeat([i for i, _, _ in found], [len(near) for _, near, _ in found]).astype(int)
        near, exact = (np.concatenate([f[k] for f in found]) for k in (1, 2))
        return pd.DataFrame({"query_id": query_ids[of], "own": owns[of], "vec_id": ids[near], "score": exact})

    found = left.groupBy("d", "q", "r").cogroup(right.groupBy("d", "q", "r")).applyInPandas(best, "query_id long, own long, vec_id long, score double")
    order = Window.partitionBy("query_id", "own").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.select("query_id", "rank", "vec_id", "score")


def op4_one_bit_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of every twentieth vector; see ``search`` for the edge cases."""
    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)
