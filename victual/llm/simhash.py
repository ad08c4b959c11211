"""Near-duplicates by SimHash, found through an index of fingerprint bytes.

A text's fingerprint has 64 bits, so eight bytes.  Two fingerprints that differ
in at most four bits agree in at least ``8 - 4 = 4`` bytes at the same place.
The index therefore lists fingerprints by what stands at byte positions; for
each pair that meets in a list the shared positional bytes are tallied, pairs
below the guaranteed four are dropped, and the rest are verified by their bits.

The tally is the number of equal bytes of two whole fingerprints: each of the
pair's postings is there, so it's what adding up the lists that they share would
give, without a row for each pair and list.

Lists of a single position and byte would be a 256th of everything, and their
pairs quadratic.  A list here is the conjunction of three positions: ``TRIPLES``
are 20 sets of three positions such that any four positions contain one of them
(a Turan design), so no pair with four shared bytes is missed, while a list
holds one in 2**24 of what is unrelated.

Equal fingerprints are one class before anything is paired.  A list that is
long all the same is split, by what any of its pairs must share besides:

* a fourth position and its byte, as a pair shares four and the list holds three of them;
* if that is long still, one of the four bytes left but for one of its bits: four
  differing bits over four bytes leave a byte with one at most.

Each fingerprint of a long list is copied a fixed number of times, whatever the list's length.  What is long
after both is cut into blocks, and each two blocks meet in a task of
their own; a task gives a spanning forest of the links it finds, never all
pairs.  So the work of a long list is spread out and its output stays linear.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, may_be_in, table, utf8, written
from .components import components

BITS = 4
SHINGLE = 4
#: Fingerprints of a list that one task compares with each other or with another block.
BLOCK = 1024
#: Values that two positions' group and order fix: groups of 3, 3 and 2 positions.
_GROUPS = ((0, 1, 2), (3, 4, 5), (6, 7))
TRIPLES = [g for g in _GROUPS if len(g) == 3] + [
    (*two, one) for k, g in enumerate(_GROUPS) for two in combinations(g, 2) for one in _GROUPS[(k + 1) % 3]
]


def fingerprint(text: bytes, size: int = SHINGLE) -> int:
    """The SimHash of a UTF-8 text: a bit is 1 if set in over half the shingles' hashes."""
    words = text.lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    if len(words) <= size:
        return int(xxhash.xxh64_intdigest(line, 42))
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = [0, *ends[: -size].tolist()]
    digest, total = xxhash.xxh64_digest, np.zeros(64, np.int64)
    stops = (ends[size - 1 :] - 1).tolist()
    for at in range(0, len(starts), 1 << 15):  # bounded memory for very long texts
        hashes = b"".join([digest(line[a:b], 42) for a, b in zip(starts[at : at + (1 << 15)], stops[at : at + (1 << 15)])])
        total += np.unpackbits(np.frombuffer(hashes, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(total * 2 > len(starts)).tobytes(), "big")


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = np.array([fingerprint(t.as_buffer().to_pybytes()) for t in batch.column("_text")], np.uint64).view(np.int64)
        names = [n for n in batch.schema.names if n != "_text"]
        yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(found, pa.int64())], names=[*names, "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id, tkey, fp`` of each row of ``docs(doc_id, text)``: a hash of the text, and the fingerprint's bits as a long."""
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("tkey"), utf8("text").alias("_text"))
    return rows.mapInArrow(_fingerprints, "doc_id long, tkey long, fp long")


def _pairs(fps: np.ndarray, left: np.ndarray, right: np.ndarray, bits: int) -> np.ndarray:
    """Of index pairs, a mask of those that share enough positional bytes and, verified, bits."""
    differ = fps[left] ^ fps[right]
    shared = (differ.view(np.uint8).reshape(-1, 8) == 0).sum(axis=1, dtype=np.uint8)
    near = np.flatnonzero(shared >= 8 - bits)
    mask = np.zeros(len(left), bool)
    mask[near] = np.bitwise_count(differ[near]) <= bits
    return mask


def forest(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """For each of ``n`` nodes, the smallest node it reaches over the links."""
    root = np.arange(n)
    while len(left):
        a, b = root[left], root[right]
        low, high = np.minimum(a, b), np.maximum(a, b)
        open_ = low != high
        if not open_.any():
            break
        left, right = left[open_], right[open_]
        np.minimum.at(root, high[open_], low[open_])
        while not (up := root[root]).tobytes() == root.tobytes():
            root = up
    return root


def _link_long(fps: np.ndarray, bits: int) -> np.ndarray:
    """As ``forest`` for one long list, 128 rows at a time."""
    m = len(fps)
    nodes = root = np.arange(m)
    for row in range(0, m, 128):
        left, right = (x.ravel() for x in np.meshgrid(nodes[row : row + 128], nodes[row:], indexing="ij"))
        later = right > left
        left, right = left[later], right[later]
        ok = _pairs(fps, left, right, bits)
        root = forest(m, np.r_[left[ok], nodes], np.r_[right[ok], root])
    return root


def link_lists(keys: np.ndarray, fps: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Links ``(fingerprint, smaller one)`` that span each list's components; ``keys`` are sorted, lists are runs.

    Short lists are taken all at once, neighbours at a growing gap; long ones a
    slice of rows at a time, so memory is bounded.
    """
    n = len(keys)
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if n else np.zeros(0, int)
    sizes = np.diff(np.r_[starts, n])
    ends, nodes = np.repeat(starts + sizes, sizes), np.arange(n)
    lefts, rights = [nodes], [nodes]
    at, gap = np.flatnonzero(np.repeat(sizes <= 64, sizes)), 1
    while len(at := at[at + gap < ends[at]]):
        ok = at[_pairs(fps, at, at + gap, bits)]
        lefts.append(ok)
        rights.append(ok + gap)
        gap += 1
    for start, size in zip(starts[sizes > 64], sizes[sizes > 64]):
        lefts.append(nodes[start : start + size])
        rights.append(start + _link_long(fps[start : start + size], bits))
    root = forest(n, np.concatenate(lefts), np.concatenate(rights))
    moved = np.flatnonzero(root != nodes)
    return fps[moved], fps[root[moved]]


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over rows sorted by list and block pair; a list is whole within its partition."""
    keys, fps = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def out(keys: np.ndarray, fps: np.ndarray) -> pa.RecordBatch:
        a, b = link_lists(keys, fps.view(np.uint64))
        return pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in (a, b)], names=["a", "b"])

    for batch in batches:
        keys = np.r_[keys, batch.column(0).to_numpy(zero_copy_only=False)]
        fps = np.r_[fps, batch.column(1).to_numpy(zero_copy_only=False)]
        cut = np.searchsorted(keys, keys[-1]) if len(keys) else 0
        if cut >= 20_000:
            yield out(keys[:cut], fps[:cut])
            keys, fps = keys[cut:], fps[cut:]
    if len(keys):
        yield out(keys, fps)


def lists(face: str) -> Column:
    """The lists that a fingerprint is in: a triple's number and the three bytes at its positions."""
    def byte(p: int) -> Column:
        return F.shiftrightunsigned(face, 8 * (7 - p)).bitwiseAND(F.lit(255))
    return F.array(*[F.lit(k << 24) + byte(a) * (1 << 16) + byte(b) * (1 << 8) + byte(c) for k, (a, b, c) in enumerate(TRIPLES)])


def deal(index: DataFrame, block: int = BLOCK) -> DataFrame:
    """``index(list, fp, ...)`` without lists of one row, as ``part, fp, ...``: whole parts in a partition, sorted.

    Blocks of a long list are drawn by a hash of the fingerprint; each two
    blocks are a part, so every pair of the list is in one.
    """
    rest = [c for c in index.columns if c != "list"]
    sizes = index.groupBy("list").agg(F.count("*").alias("n")).where("n > 1")
    met = index.join(sizes, "list").withColumn("blocks", F.ceil(F.col("n") / block).cast("int"))
    short = met.where("blocks = 1").select(F.col("list").cast("long").alias("part"), *rest)
    own = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    pair = F.transform(
        F.sequence(F.lit(0), F.col("blocks") - 1), lambda other: F.struct(F.least(other, "own").alias("i"), F.greatest(other, "own").alias("j"))
    )
    # Blocks meet in pairs (i, j); a pair with itself is within each of its pairs.
    long_ones = (
        met.where("blocks > 1").withColumn("own", own).withColumn("pair", F.explode(F.filter(pair, lambda p: p.i < p.j)))
        .select(F.xxhash64("list", "pair").alias("part"), *rest)
    )
    return short.unionByName(long_ones).repartition("part").sortWithinPartitions("part", "fp")


def _long(index: DataFrame, block: int) -> tuple[DataFrame, DataFrame | None]:
    """The rows of ``index(list, ...)`` in lists of up to ``block`` rows, and those in longer ones (None if there are none)."""
    crowded = written(index.groupBy("list").agg(F.count("*").alias("n")).where(F.col("n") > block).select("list"), "crowded")
    if crowded.isEmpty():
        return index, None
    return index.join(crowded, "list", "left_anti"), index.join(crowded, "list", "left_semi")


def _left_over(used: str) -> Column:
    """The positions that aren't in a list's bitmap of those it is made of."""
    return F.filter(F.array(*[F.lit(p) for p in range(8)]), lambda p: F.expr(used).bitwiseAND(F.call_function("shiftleft", F.lit(1), p)) == 0)


def split_lists(fps: DataFrame, block: int = BLOCK) -> DataFrame:
    """``list, fp``: the lists of distinct fingerprints, those of more than ``block`` rows split twice; a pair within reach shares one."""
    kinds = F.array(*[F.lit(sum(1 << p for p in triple)) for triple in TRIPLES])
    index = fps.select("fp", F.posexplode(lists("fp")).alias("k", "list")).select(F.col("list").cast("long").alias("list"), F.get(kinds, F.col("k")).alias("used"), "fp")
    short, rest = _long(index, block)
    out = short.select("list", "fp")
    at = F.expr("cast(shiftrightunsigned(fp, 8 * (7 - p)) & 255 as int)")
    used = F.expr("used | shiftleft(1, p)").alias("used")
    if rest is not None:
        fourth = rest.withColumn("p", F.explode(_left_over("used"))).select(F.xxhash64("list", "p", at).alias("list"), used, "fp")
        short, rest = _long(fourth, block)
        out = out.unionByName(short.select("list", "fp"))
    if rest is not None:
        one = F.explode(F.array(*[F.lit(1 << k) for k in range(8)]))
        fifth = rest.withColumn("p", F.explode(_left_over("used"))).withColumn("bit", one)
        out = out.unionByName(fifth.select(F.xxhash64("list", "p", "bit", at.bitwiseAND(F.bitwise_not("bit"))).alias("list"), "fp"))
    return out


def links(fps: DataFrame, block: int = BLOCK) -> DataFrame:
    """``(a, b)``: links that span the components of distinct fingerprints ``fps(fp)``."""
    bounded_batches(fps.sparkSession)
    dealt = deal(split_lists(fps, block), block)
    return dealt.mapInArrow(_links, "a long, b long").distinct()


def _placed(rows: DataFrame) -> DataFrame:
    """``fp, least, root`` of each distinct fingerprint: its smallest doc_id, and the component's smallest fingerprint."""
    classes = written(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "classes")
    roots = components(links(classes.select("fp")))
    return classes.join(roots, classes.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``doc_id, fingerprint, component_id`` of each row of ``docs(doc_id, text)``.

    The fingerprint is 16 lower-case hex digits, the component_id the smallest
    doc_id reachable over links of at most four differing bits.  Null and empty
    texts have fingerprint zero and link like any other; a null doc_id gets a
    component like the rest but is never the smallest unless alone.  A very long
    text is read whole, 32,768 shingles at a time.  Bits that half of the shingles
    have are 0.  Repeated rows each keep their row; an empty table gives an empty
    result; extra columns are ignored.
    """
    rows = written(fingerprints(docs), "fingerprints")
    placed = _placed(rows)
    smallest = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    members = placed.join(smallest, "root").select(F.col("fp").alias("of"), "component_id")
    joined = rows.join(members, rows.fp == members.of)
    return joined.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def by_bits(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """For ``keep_one``: ``doc_id, tkey, fp`` of each row, and the groups that links of at most four bits make."""
    rows = written(fingerprints(docs), "fingerprints")
    return rows, _placed(rows)


def keep_one(docs: DataFrame, groups: Callable[[DataFrame], tuple[DataFrame, DataFrame]] = by_bits) -> DataFrame:
    """``docs`` with one row of each near-duplicate component: the smallest doc_id's, of its texts that of the smallest hash.

    ``groups`` tells what is a component: ``by_bits``, or ``minhash.by_shingles``.

    Rows that repeat that doc_id and text are reduced to one, the smallest by its
    other columns' hash.  Rows without doc_id stay.  Null and empty texts are one
    component.  Extra columns are kept, whatever their names.

    Only rows that go or repeat are marked, in a bitmap of constant size; the others
    aren't shuffled.
    """
    columns = docs.columns
    names = [c if c in ("doc_id", "text") else f"_keep{i}" for i, c in enumerate(columns)]
    docs = docs.toDF(*names)
    rows, placed = groups(docs.where("doc_id is not null"))
    roots = placed.select(F.col("fp").alias("of"), "root")
    texts = rows.groupBy("doc_id", "tkey", "fp").agg(F.count("*").alias("n")).join(roots, F.col("fp") == F.col("of"))
    texts = written(texts.select("doc_id", "tkey", "root", "n"), "texts")
    first = texts.groupBy("root").agg(F.min(F.struct("doc_id", "tkey")).alias("first"))
    judged = texts.join(first, "root").withColumn("_kept", F.struct("doc_id", "tkey") == F.col("first"))
    judged = written(judged.where("not _kept or n > 1").select(F.col("doc_id").alias("_doc"), F.col("tkey").alias("_tkey"), "_kept"), "judged")
    own = F.xxhash64("text")
    key = F.xxhash64(F.col("doc_id").cast("long"), own)
    marked, found = may_be_in(docs, key, judged.select(F.xxhash64("_doc", "_tkey").alias("_h")))
    hit = found & F.col("doc_id").isNotNull()
    held = marked.where(hit).select(*names).join(judged.hint("merge"), (F.col("doc_id").cast("long") == F.col("_doc")) & (own == F.col("_tkey")), "left")
    kept = marked.where(~hit).select(*names).unionByName(held.where("_kept is null").select(*names))
    if not judged.where("_kept").isEmpty():
        again = held.where("_kept").select(*names)
        rest = again.groupBy("doc_id", F.xxhash64("text")).agg(F.min_by(F.struct(*names), F.xxhash64(*names)).alias("row"))
        kept = kept.unionByName(rest.select("row.*"))
    return kept.toDF(*columns)


def op8_simhash_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document; see ``near_duplicates`` for the edge cases."""
    return near_duplicates(table(spark, sf_dir, "documents"))
