"""Near-duplicates by MinHash: texts whose sets of word shingles have a Jaccard similarity of 0.8 or more.

1. *Sketch.*  ``BANDS * ROWS`` universal hashes (odd multiplier and shift modulo 2**32) of a set's shingles,
   and the minimum of each.  Texts with equal sets are one class before anything is compared.
2. *Bands.*  ``ROWS`` minima make a band's key.  Two classes of similarity s share a given band with
   chance s**ROWS, so at 0.8 they share none of ``BANDS`` with chance 5e-9.
3. *Signature.*  A byte of each minimum.  The share of equal bytes estimates the similarity; pairs
   ``SLACK`` standard errors below 0.8 are dropped.
4. *Confirm.*  What is left is decided on the full sets, made again from the texts: only those texts are shuffled.
5. *Components.*  Alternating large and small stars over the confirmed links.

A crowded list never gives all its pairs.  First each class is confirmed against the smallest
member of its lists, the one that most of them name, and what is linked becomes a cluster.  From
then on only pairs across clusters count, as others change nothing: in a list, all but its largest cluster are
compared with everything else, in blocks.  First the best partners of each are confirmed,
which merges nearly all that can be; then all pairs that are left are refuted or proposed where their blocks meet, by 32 bits
of each shingle.  So no pair is written that isn't nearly certain to be a link, and no link between components is passed over.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, may_be_in, table, utf8, written
from .components import components

#: Words of a shingle, and least similarity in percent.
SHINGLE, LIKE = 5, 80
BANDS, ROWS = 48, 5
SLACK = 5.0
#: Classes of a block; each two blocks of a list meet in a task of their own.
BLOCK = 512
#: Band keys that a class shares with its smallest partner at least, for the two to be confirmed before others.
SHARED = 3
#: Texts that one task confirms against others: those that it holds, and those that pass by.
HELD, PASSING = 64, 512
_draw = np.random.default_rng(20)
_TIMES = _draw.integers(0, 1 << 31, BANDS * ROWS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_PLUS = _draw.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint32)
_BASE = np.uint64(0x9E3779B97F4A7C15)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def shingles(text: bytes, size: int = SHINGLE) -> np.ndarray:
    """The sorted 64-bit hashes of a UTF-8 text's distinct shingles; of all its words, if there are fewer than a shingle's."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    last = max(1, len(words) - size + 1)
    out = hashes[:last].copy()
    for k in range(1, min(size, len(words))):
        out = _mixed(out * _BASE + hashes[k : k + last])
    return np.unique(out)


def minima(found: np.ndarray) -> np.ndarray:
    """The minimum of each universal hash over hashes of shingles."""
    out = np.full(BANDS * ROWS, 0xFFFFFFFF, np.uint32)
    folded = (found >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(folded), 256):  # bounded memory for very long texts
        out = np.minimum(out, (folded[at : at + 256, None] * _TIMES + _PLUS).min(axis=0))
    return out


def signature(least: np.ndarray) -> bytes:
    return ((least ^ (least >> np.uint32(15))) * np.uint32(0x9E3779B1) >> np.uint32(24)).astype(np.uint8).tobytes()


def band_keys(least: np.ndarray) -> np.ndarray:
    rows = least.reshape(BANDS, ROWS).astype(np.uint64)
    out = np.arange(BANDS, dtype=np.uint64)
    for k in range(ROWS):
        out = _mixed(out * _BASE + rows[:, k])
    return out


_SKETCH = "doc_id long, tkey long, n_shingles long, skey binary, signature binary, bands array<long>"


def _sketched(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts, keys, marks, bands = [], [], [], []
        for text in batch.column("_text"):
            found = shingles(text.as_buffer().to_pybytes(), size)
            least = minima(found)
            counts.append(len(found))
            keys.append(xxhash.xxh3_128_digest(found.tobytes()))
            marks.append(signature(least))
            bands.append(band_keys(least))
        held = pa.array(np.array(bands, np.uint64).ravel().view(np.int64))
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(counts) + 1, dtype=np.int32) * BANDS), held)
        columns = [batch.column("doc_id"), batch.column("tkey"), pa.array(counts, pa.int64()), pa.array(keys, pa.binary()), pa.array(marks, pa.binary()), lists]
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "tkey", "n_shingles", "skey", "signature", "bands"])


def sketches(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """``doc_id``, a hash of the text, the size of the set, its digest, signature and band keys, of each row of ``docs(doc_id, text)``."""
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("tkey"), utf8("text").alias("_text"))
    return rows.mapInArrow(partial(_sketched, size=size), _SKETCH)


# ------------------------------------------------------------- confirmation


def _whole_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[dict]]]:
    """The rows of each value of the first column, which are together, some at a time."""
    for batch in batches:
        keys = batch.column(0).to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
        for a, b in zip(cuts, cuts[1:]):
            if b > a:
                yield int(keys[a]), batch.slice(a, b - a).to_pylist()


def _confirmed(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Links among rows sorted by part; those to be held (without partners) come first."""
    part, held = None, {}
    for key, rows in _whole_keys(batches):
        if key != part:
            part, held = key, {}
        left, right = [], []
        for row in rows:
            own = shingles(row["text"], size)
            if row["partners"] is None:
                held[row["node"]] = own
                continue
            for other in row["partners"]:
                both = len(own) + len(held[other])
                shared = both - len(np.union1d(own, held[other]))
                if 100 * shared >= LIKE * (both - shared):
                    left.append(row["node"])
                    right.append(other)
        yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], names=["a", "b"])


def texts_of(docs: DataFrame, classes: DataFrame, nodes: DataFrame) -> DataFrame:
    """``node, text`` of the representatives of ``nodes(node)``; a bitmap of constant size tells which texts needn't be shuffled."""
    wanted = written(classes.join(nodes, "node").select("node", F.col("rep.doc_id").alias("_doc"), F.col("rep.tkey").alias("_tkey")), "wanted")
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("tkey"), utf8("text").alias("text"))
    marked, found = may_be_in(own, F.xxhash64("doc_id", "tkey"), wanted.select(F.xxhash64("_doc", "_tkey").alias("_h")))
    held = marked.where(found).select("doc_id", "tkey", "text").join(wanted, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("tkey") == F.col("_tkey")))
    return held.groupBy("node").agg(F.first("text").alias("text"))


def confirm(docs: DataFrame, classes: DataFrame, pairs: DataFrame, size: int) -> DataFrame:
    """Of ``pairs(a, b, of)`` those with alike full sets, as ``a, b``.

    The ``a`` of one ``of`` are dealt into blocks of some ``HELD``.  A task holds a block's sets, and
    each ``b`` passes by once with all its partners in the block, so a text travels once a block and not once a pair.
    A block that many pass by is copied for each ``PASSING`` of them.
    """
    blocks = pairs.select("of", "a").distinct().groupBy("of").agg(F.ceil(F.count("*") / HELD).alias("blocks"))
    keyed = pairs.join(blocks, "of").select(F.xxhash64("of", F.pmod(F.xxhash64("a"), F.col("blocks"))).alias("block"), "a", "b").distinct()
    keyed = written(keyed, "pairs")
    if keyed.isEmpty():
        return keyed.select("a", "b")
    passing = keyed.groupBy("block", "b").agg(F.collect_set("a").alias("partners"))
    loads = passing.groupBy("block").agg(F.ceil(F.count("*") / PASSING).cast("int").alias("copies"))
    copied = keyed.select("block", "a").distinct().join(loads, "block").withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
    went = passing.join(loads, "block").withColumn("copy", F.pmod(F.xxhash64("b"), F.col("copies")).cast("int"))
    part = F.xxhash64("block", "copy").alias("part")
    rows = copied.select(part, F.col("a").alias("node"), F.lit(None).cast("array<long>").alias("partners")).unionByName(went.select(part, F.col("b").alias("node"), "partners"))
    # Written, so that the plan that moves the texts, the largest of all, holds nothing of how they are dealt.
    rows = written(rows, "passing")
    texts = texts_of(docs, classes, keyed.select(F.col("a").alias("node")).union(keyed.select("b")).distinct())
    met = rows.join(texts, "node").select("part", "node", "partners", "text").repartition("part").sortWithinPartitions("part", F.col("partners").isNotNull())
    return written(met.mapInArrow(partial(_confirmed, size=size), "a long, b long"), "links")


# --------------------------------------------------------------- candidates


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of each part, which are sorted by it."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        keys = batch.column("part").to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
        for a, b in zip(cuts, cuts[1:]):
            if b == a:
                continue
            if held and held[0].column("part")[0].as_py() != keys[a]:
                yield pa.concat_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.concat_batches(held)


def _facing(rows: pa.RecordBatch) -> tuple[np.ndarray, Iterator[tuple[int, np.ndarray]]]:
    """A part's nodes, and for each row outside the list's largest cluster itself and the rows of other clusters that it meets."""
    node, root, block, main = (rows.column(n).to_numpy(zero_copy_only=False) for n in ("node", "root", "block", "main"))
    alone = (block == block[0]).all()  # the part is a block by itself, else two that meet

    def each() -> Iterator[tuple[int, np.ndarray]]:
        for i in np.flatnonzero(~main).tolist():
            yield i, np.flatnonzero((root != root[i]) & (alone | (block != block[i])))

    return node, each()


def _alike(batches: Iterator[pa.RecordBatch], best: bool) -> Iterator[pa.RecordBatch]:
    """What signatures tell of the pairs across clusters: the best partners of each row outside the largest cluster, or all rows with a partner."""
    total = BANDS * ROWS
    least = (LIKE / 100 - SLACK * (LIKE / 100 * (1 - LIKE / 100) / total) ** 0.5) * total
    for rows in _parts(batches):
        node, pairs = _facing(rows)
        marks = np.frombuffer(b"".join(rows.column("signature").to_pylist()), np.uint8).reshape(-1, total)
        main = rows.column("main").to_numpy(zero_copy_only=False)
        a, b, alike, met = [], [], [], np.zeros(len(node), bool)
        for i, at in pairs:
            same = (marks[at] == marks[i]).sum(axis=1, dtype=np.int32)
            near = np.flatnonzero(same >= least)
            if not len(near):
                continue
            if not best:
                met[i] = met[at[near]] = True
                continue
            order = near[np.argsort(-same[near], kind="stable")]
            for k in {order[0], *order[main[at[order]]][:1]}:  # of all clusters, and of the largest
                a.append(int(node[i]))
                b.append(int(node[at[k]]))
                alike.append(int(same[k]))
        if best:
            of = rows.column("of")[0].as_py()
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array([of] * len(a), pa.int64()), pa.array(alike, pa.int32())], names=["a", "b", "of", "alike"])
        else:
            yield rows.filter(pa.array(met)).select(["part", "node", "root", "block", "main", "of"])


def _refuted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs across clusters whose sets may be alike, by 32 bits of each shingle: equal bits are never fewer than equal shingles."""
    for rows in _parts(batches):
        node, pairs = _facing(rows)
        prints = [np.frombuffer(p, np.uint32) for p in rows.column("prints").to_pylist()]
        sizes = np.array([len(p) for p in prints])
        words, place = np.unique(np.concatenate(prints), return_inverse=True)
        common = np.bincount(place) > 1
        slot = np.cumsum(common) - 1
        of_row = np.repeat(np.arange(len(prints)), sizes)
        kept = common[place]
        of_row, place = of_row[kept], slot[place[kept]]
        shared = np.zeros((len(prints), len(prints)), np.float32)
        for at in range(0, int(common.sum()), 2048):  # bounded memory: so many distinct shingles at a time
            here = (place >= at) & (place < at + 2048)
            held = np.zeros((len(prints), 2048), np.float32)
            np.add.at(held, (of_row[here], place[here] - at), 1)
            shared += held @ held.T
        a, b = [], []
        for i, at in pairs:
            ok = at[(100 + LIKE) * shared[i, at] >= LIKE * (sizes[i] + sizes[at])]
            a += [int(node[i])] * len(ok)
            b += node[ok].tolist()
        of = rows.column("of")[0].as_py()
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (a, b, [of] * len(a))], names=["a", "b", "of"])


def _printed(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = [(shingles(t.as_buffer().to_pybytes(), size) >> np.uint64(32)).astype(np.uint32).tobytes() for t in batch.column("text")]
        yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(prints, pa.binary())], names=["node", "prints"])


def dealt(met: DataFrame, roots: DataFrame, block: int) -> DataFrame:
    """The rows of ``met(list, node)`` in lists of more than one cluster of ``roots(node, root)``, in parts where blocks meet.

    A list's largest cluster isn't compared with itself, so its blocks only meet those of the others.
    """
    rows = met.join(roots, "node", "left").select("list", "node", F.coalesce("root", "node").alias("root"))
    sizes = rows.groupBy("list", "root").agg(F.count("*").alias("n"))
    mixed = sizes.groupBy("list").agg(F.max(F.struct("n", "root")).alias("most"), F.sum("n").alias("n"), F.count("*").alias("clusters")).where("clusters > 1")
    blocks = lambda n: F.ceil(n / block).cast("int")
    mixed = mixed.select("list", F.col("most.root").alias("of"), blocks(F.col("most.n")).alias("mains"), blocks(F.col("n") - F.col("most.n")).alias("others"))
    mixed = written(mixed, "mixed")
    rows = rows.join(mixed, "list").withColumn("main", F.col("root") == F.col("of"))
    own = F.pmod(F.xxhash64("node"), F.when(F.col("main"), F.col("mains")).otherwise(F.col("others"))).cast("int")
    rows = rows.withColumn("block", own + F.when(F.col("main"), 0).otherwise(F.col("mains")))
    # A block of the largest cluster meets those of the others; one of the others meets all, itself too.
    first = F.when(F.col("main"), F.col("mains")).otherwise(F.lit(0))
    facing = rows.withColumn("facing", F.explode(F.sequence(first, F.col("mains") + F.col("others") - 1)))
    part = F.xxhash64("list", F.least("block", "facing"), F.greatest("block", "facing"))
    return facing.select(part.alias("part"), "node", "root", "block", "main", "of")


def _in_parts(rows: DataFrame) -> DataFrame:
    return rows.repartition("part").sortWithinPartitions("part", "node")


def best_partners(met: DataFrame, roots: DataFrame, classes: DataFrame, block: int) -> DataFrame:
    """``a, b, of``: for each class outside its lists' largest clusters, the partners in other clusters of the most alike signatures."""
    rows = _in_parts(dealt(met, roots, block).join(classes.select("node", "signature"), "node"))
    pairs = rows.mapInArrow(partial(_alike, best=True), "a long, b long, of long, alike int")
    pick = F.max_by(F.struct("b", "of"), F.struct("alike", -F.col("b"))).alias("to")
    return written(pairs.groupBy("a", "of").agg(pick).select("a", "to.*"), "candidates")


def all_partners(docs: DataFrame, met: DataFrame, roots: DataFrame, classes: DataFrame, size: int, block: int) -> DataFrame:
    """``a, b, of``: every pair across clusters that shares a list, but for those that signatures or shingles' bits refute.

    Pairs are refuted where their blocks meet, so none is ever written that could not be a link.
    """
    rows = _in_parts(dealt(met, roots, block).join(classes.select("node", "signature"), "node"))
    kind = "part long, node long, root long, block int, main boolean, of long"
    near = written(rows.mapInArrow(partial(_alike, best=False), kind), "near")
    if near.isEmpty():
        return near.select(F.col("node").alias("a"), F.col("root").alias("b"), "of")
    prints = texts_of(docs, classes, near.select("node").distinct()).mapInArrow(partial(_printed, size=size), "node long, prints binary")
    pairs = _in_parts(near.join(prints, "node")).mapInArrow(_refuted, "a long, b long, of long")
    return written(pairs.groupBy("a", "b").agg(F.min("of").alias("of")), "candidates")


def _merged(roots: DataFrame, more: DataFrame) -> DataFrame:
    """``roots(node, root)`` once links ``more(a, b)`` have joined clusters: only the clusters' own graph is searched."""
    ends = more
    for end in ("a", "b"):
        own = roots.select(F.col("node").alias(end), F.col("root").alias(f"_{end}"))
        ends = ends.join(own, end, "left").withColumn(end, F.coalesce(f"_{end}", end)).drop(f"_{end}")
    up = written(components(ends.select("a", "b")), "merged")
    moved = roots.join(up.select(F.col("node").alias("root"), F.col("root").alias("_top")), "root", "left").select("node", F.coalesce("_top", "root").alias("root"))
    return written(moved.unionByName(up.join(roots, "node", "left_anti")), "roots")


def clusters(docs: DataFrame, classes: DataFrame, size: int, block: int = BLOCK) -> DataFrame:
    """``node, root``: the components of ``classes(node, rep, signature, bands)`` by confirmed links; those without a link are left out."""
    index = classes.select(F.explode("bands").alias("list"), "node")
    crowded = index.groupBy("list").agg(F.count("*").alias("n"), F.min("node").alias("first")).where("n > 1").select("list", "first")
    met = written(index.join(crowded, "list"), "lists")
    shared = met.where("node <> first").repartition("node").groupBy("node", "first").agg(F.count("*").alias("n"))
    named = shared.groupBy("node").agg(F.max_by(F.struct("first", "n"), F.struct("n", -F.col("first"))).alias("to")).where(F.col("to.n") >= SHARED)
    found = confirm(docs, classes, named.select(F.col("to.first").alias("a"), F.col("node").alias("b"), F.col("to.first").alias("of")), size)
    roots = written(components(found), "roots")
    # Most clusters have a link with what looks most alike to them, and half of the lists show that; what is left is compared in all of them.
    half = met.where(F.pmod("list", F.lit(2)) == 0)
    for pairs in (lambda: best_partners(half, roots, classes, block), lambda: all_partners(docs, met, roots, classes, size, block)):
        more = confirm(docs, classes, pairs(), size)
        if not more.isEmpty():
            roots = _merged(roots, more)
    return roots


def _placed(docs: DataFrame, size: int, block: int) -> tuple[DataFrame, DataFrame]:
    """The sketches of all rows, and ``skey, node, least, root`` of each distinct set that isn't empty."""
    bounded_batches(docs.sparkSession)
    rows = written(sketches(docs, size), "sketches")
    some = rows.where("n_shingles > 0").groupBy("skey").agg(
        F.min("doc_id").alias("least"), F.min(F.struct("doc_id", "tkey")).alias("rep"), F.first("signature").alias("signature"), F.first("bands").alias("bands")
    )
    # Numbers are given as the table is written, so they are the same whenever it is read.
    classes = written(some.withColumn("node", F.monotonically_increasing_id()), "classes")
    roots = clusters(docs, classes, size, block)
    return rows, classes.select("skey", "node", "least").join(roots, "node", "left").select("skey", "node", "least", F.coalesce("root", "node").alias("root"))


def by_shingles(docs: DataFrame, size: int = SHINGLE, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """For ``simhash.keep_one``: ``doc_id, tkey, fp`` of each row whose text has words, and the groups that links of ``LIKE`` percent make.

    A text without words is in no group, so it stays.
    """
    rows, placed = _placed(docs, size, block)
    own = rows.where("n_shingles > 0").join(placed.select("skey", F.col("node").alias("fp")), "skey").select("doc_id", "tkey", "fp")
    return own, placed.select(F.col("node").alias("fp"), "least", "root")


def near_duplicates(docs: DataFrame, size: int = SHINGLE, block: int = BLOCK) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` of each row of ``docs(doc_id, text)``.

    ``n_shingles`` is the number of a text's distinct shingles of ``size`` words (A-Z lower-cased), the
    component_id the smallest doc_id reachable over links of at least ``LIKE`` percent, and ``kept`` tells whether it is the row's own.

    A text with fewer words than a shingle is one shingle.  Null texts, and those without words, have none, are linked with
    nothing and stay.  Equal sets are alike whatever the texts.  A null doc_id gets a component like the rest but
    is never the smallest unless alone.  Very long texts are read whole.  Repeated rows each keep
    their row; rows of one doc_id with different texts are judged by their texts.  An empty table gives an empty result, and extra columns are ignored.
    """
    rows, placed = _placed(docs, size, block)
    members = placed.join(placed.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("skey", "component_id")
    out = rows.select("doc_id", "skey", "n_shingles").where("n_shingles > 0").join(members, "skey").select("doc_id", "n_shingles", "component_id")
    alone = rows.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return out.unionByName(alone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def op13_minhash_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents by their four-word shingles; see ``near_duplicates`` for the edge cases."""
    return near_duplicates(table(spark, sf_dir, "documents"), 4)
