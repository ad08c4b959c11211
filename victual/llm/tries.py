"""Prefix tries of conversations: which ones begin alike, and what sharing their beginnings saves.

A node is a distinct sequence of first turns.  Turns are known by a digest of role and text, so texts are never shuffled.

1. Conversations of equal turns are one class, so copies cost nothing further on.
2. Classes are partitioned by the digest of their first turn: each bucket holds whole first-turn subtries,
   and a task builds them as dictionaries of pointers (node, digest) -> node and sums them up without
   recursion, children before parents.
3. A subtrie of more than ``LIMIT`` turns is never given to a task.  What all its classes begin with becomes a chain of nodes
   (the common prefix of the least and the greatest path), and its classes are
   partitioned again, by the turn after it; and so on, until all subtries are small.
4. Sums of what was split come from the deepest level upwards.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, written

#: Turns of a subtrie that one task builds.
LIMIT = 10_000
#: Conversations of one block begin like its first one, in the query.
BLOCK, MOST = 100, 6

_NODE = "top_conv long, top_depth int, conv_id long, depth int, parent_conv_id long, digest binary, n_convs long, n_children long, n_leaves long, saved_tokens long, class long"
_PLACE = ["top_conv", "top_depth", "next"]


def _said() -> tuple[Column, Column]:
    return F.coalesce(F.col("role"), F.lit("")), F.coalesce(F.col("text"), F.lit(""))


def _digest(role: Column, text: Column) -> Column:
    """128 bits of the SHA-256 of a turn; the role's length keeps the two apart."""
    said = F.concat(F.length(role).cast("string"), F.lit(":"), role, text)
    return F.unhex(F.left(F.sha2(said.cast("binary"), 256), F.lit(32)))


def paths(conversations: DataFrame) -> DataFrame:
    """``conv_id, path`` of ``conversations(conv_id, turn, role, text)``: digest and code points of each turn, in order.

    Turns without a number come first, those of one number by digest; a null role or text is empty.  Rows without a conv_id belong
    to no conversation.  A conversation's digests are one row, so it may have some 10**8 turns.
    """
    role, text = _said()
    turns = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.struct(F.col("turn"), _digest(role, text).alias("digest"), F.length(text).alias("size")).alias("t"))
    ordered = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("ts"))
    return ordered.select("conv_id", F.transform("ts", lambda t: F.struct(t["digest"].alias("digest"), t["size"].alias("size"))).alias("path"))


def _saved(n_convs: Column, size: Column) -> Column:
    return (n_convs - 1) * size.cast("long")


def _built(rows: pd.DataFrame) -> pd.DataFrame:
    """The nodes of the subtries in one bucket."""
    child: dict[tuple, int] = {}
    tops, conv, depth, parent, digest, size, n_convs, ends = [], [], [], [], [], [], [], []
    for top_conv, top_depth, least, n, turns, sizes in rows[["top_conv", "top_depth", "least", "n", "turns", "sizes"]].itertuples(index=False):
        at, level = (top_conv, top_depth), int(top_depth)
        up = -1
        for turn, points in zip(turns, sizes):
            level += 1
            key = (at, bytes(turn))
            node = child.get(key)
            if node is None:
                node = child[key] = len(conv)
                tops.append((top_conv, top_depth))
                conv.append(least)
                depth.append(level)
                parent.append(up)
                digest.append(key[1])
                size.append(int(points))
                n_convs.append(0)
                ends.append(None)
            elif least < conv[node]:
                conv[node] = least
            n_convs[node] += n
            at = up = node
        ends[at] = least
    count = len(conv)
    children, leaves, saved = [0] * count, [0] * count, [0] * count
    for node in range(count - 1, -1, -1):  # a node is made after its parent, so this is a postorder
        if not children[node]:
            leaves[node] = 1
        saved[node] += (n_convs[node] - 1) * size[node]
        if (up := parent[node]) >= 0:
            children[up] += 1
            leaves[up] += leaves[node]
            saved[up] += saved[node]
    return pd.DataFrame(
        {
            "top_conv": [t[0] for t in tops], "top_depth": [t[1] for t in tops], "conv_id": conv, "depth": depth, "parent_conv_id": [t[0] if up < 0 else conv[up] for t, up in zip(tops, parent)],
            "digest": digest, "n_convs": n_convs, "n_children": children, "n_leaves": leaves, "saved_tokens": saved, "class": pd.array(ends, "Int64"),
        }
    )


def _below(nodes: DataFrame) -> DataFrame:
    """What the subtries of each place sum up to, of the nodes right under it."""
    tops = nodes.where("depth = top_depth + 1").groupBy("top_conv", "top_depth")
    return tops.agg(F.count("*").alias("n"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"))


def _split(pending: DataFrame, limit: int) -> tuple[DataFrame, DataFrame | None, DataFrame | None]:
    """Nodes of the small subtries under the places of ``pending``, the chains of the others, and the classes that go on below those."""
    rest = pending.where("size(path) > top_depth").withColumn("next", F.get("path", F.col("top_depth"))["digest"])
    sums = rest.groupBy(*_PLACE).agg(F.sum(F.size("path") - F.col("top_depth")).alias("turns"), F.min("least").alias("conv_id"), F.sum("n").alias("n_convs"))
    sums = written(sums, "subtries")
    large = sums.where(F.col("turns") > limit)
    left = sums.where(F.col("turns") <= limit).agg(F.sum("turns").alias("turns")).first()["turns"] or 0
    split = not large.isEmpty()
    small = rest.join(large.select(*_PLACE), _PLACE, "left_anti") if split else rest
    tail = lambda field: F.slice(F.col(f"path.{field}"), F.col("top_depth") + 1, F.size("path") - F.col("top_depth"))
    bucket = F.pmod(F.xxhash64(*_PLACE), F.lit(-(-left // limit) or 1))
    dealt = small.select(bucket.alias("bucket"), "top_conv", "top_depth", "least", "n", tail("digest").alias("turns"), tail("size").alias("sizes"))
    nodes = written(dealt.groupBy("bucket").applyInPandas(_built, _NODE), "nodes")
    if not split:
        return nodes, None, None
    inside = rest.join(large.select(*_PLACE, "conv_id", "n_convs"), _PLACE)
    ends = inside.groupBy(*_PLACE, "conv_id", "n_convs").agg(F.min("path").alias("low"), F.max("path").alias("high"))
    differ = F.array_position(F.zip_with("low", "high", lambda a, b: a["digest"].eqNullSafe(b["digest"])), False)
    chains = ends.withColumn("common", F.when(differ == 0, F.size("low")).otherwise(differ - 1).cast("int"))
    chains = written(chains.select(*_PLACE, "conv_id", "n_convs", "common", F.slice("low", F.col("top_depth") + 1, F.col("common") - F.col("top_depth")).alias("turns")), "chains")
    onward = rest.join(chains.select(*_PLACE, "conv_id", "common"), _PLACE)
    return nodes, chains, written(onward.select(F.col("conv_id").alias("top_conv"), F.col("common").alias("top_depth"), "least", "n", "path"), "pending")


def _chain_nodes(chains: DataFrame, pending: DataFrame, below: DataFrame) -> DataFrame:
    """A node for each turn of the chains; the last one's children are the places of ``pending``, which ``below`` sums up."""
    at = lambda df: df.withColumnsRenamed({"top_conv": "_conv", "top_depth": "_depth"})
    ended = at(pending.where("size(path) = top_depth").select("top_conv", "top_depth", F.col("least").alias("class")))
    turns = chains.select("top_conv", "top_depth", "conv_id", "n_convs", "common", F.posexplode("turns").alias("_at", "t")).withColumn("depth", F.col("top_depth") + F.col("_at") + 1)
    last = (F.col("conv_id") == F.col("_conv")) & (F.col("depth") == F.col("_depth"))
    rows = turns.join(at(below), last, "left").drop("_conv", "_depth").join(ended, last, "left")
    end = F.col("depth") == F.col("common")
    children = F.when(end, F.coalesce("n", F.lit(0))).otherwise(1)
    upward = Window.partitionBy("top_conv", "top_depth", "conv_id", "common").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, 0)
    leaves = F.first(F.when(end, F.coalesce("leaves", F.lit(1)))).over(upward)
    saved = F.sum(_saved(F.col("n_convs"), F.col("t.size")) + F.coalesce("saved", F.lit(0))).over(upward)
    up = F.when(F.col("_at") == 0, F.col("top_conv")).otherwise(F.col("conv_id"))
    return rows.select(
        "top_conv", "top_depth", "conv_id", "depth", up.alias("parent_conv_id"), F.col("t.digest").alias("digest"), "n_convs", children.cast("long").alias("n_children"),
        leaves.cast("long").alias("n_leaves"), saved.alias("saved_tokens"), "class",
    )


def trie(paths: DataFrame, limit: int = LIMIT) -> tuple[DataFrame, DataFrame]:
    """The nodes of the trie of ``paths(conv_id, path)``, and ``conv_id, class`` of its conversations.

    A node has ``conv_id`` (its smallest member), ``depth``, ``parent_conv_id``, the ``digest`` of its last turn, ``n_convs``, ``n_children``,
    ``n_leaves``, ``saved_tokens``, and the ``class`` that ends there: the smallest of the conversations that have no more turns (null
    if none).  Depth and conv_id tell a node.  The root has no digest, no text and no parent; without
    conversations there is none.  A repeated conv_id counts as often as it comes.
    """
    key = F.sha2(F.array_join(F.transform("path", lambda t: F.hex(t["digest"])), "").cast("binary"), 256)
    keyed = written(paths.select("conv_id", key.alias("key"), "path"), "paths")
    classes = written(keyed.groupBy("key", "path").agg(F.min("conv_id").alias("least"), F.count("*").alias("n")), "classes")
    members = keyed.join(classes.select("key", F.col("least").alias("class")), "key").select("conv_id", "class")
    total = classes.agg(F.min("least").alias("conv"), F.sum("n").alias("n")).first()
    if total["conv"] is None:
        return paths.sparkSession.createDataFrame([], _NODE).drop("top_conv", "top_depth"), members
    levels = []
    pending: DataFrame | None = classes.select(F.lit(total["conv"]).alias("top_conv"), F.lit(0).alias("top_depth"), "least", "n", "path")
    while pending is not None:
        nodes, chains, onward = _split(pending, limit)
        levels.append((nodes, chains, onward))
        pending = onward
    out: DataFrame | None = None
    below: DataFrame | None = None
    for nodes, chains, onward in reversed(levels):
        if chains is not None:
            nodes = nodes.unionByName(written(_chain_nodes(chains, onward, below), "nodes"))
        out = nodes if out is None else out.unionByName(nodes)
        below = written(_below(nodes), "below")
    sums = below.first() or {"n": 0, "leaves": 1, "saved": 0}
    bare = classes.where("size(path) = 0").agg(F.min("least").alias("class")).first()["class"]
    top = (None, None, total["conv"], 0, None, None, total["n"], sums["n"], sums["leaves"], sums["saved"], bare)
    root = paths.sparkSession.createDataFrame([top], _NODE)
    return root.unionByName(out).drop("top_conv", "top_depth"), members


def with_texts(nodes: DataFrame, conversations: DataFrame) -> DataFrame:
    """``nodes`` with ``role`` and ``text`` of their last turn; the root has none."""
    role, text = _said()
    said = conversations.where("conv_id is not null").select(_digest(role, text).alias("digest"), role.alias("role"), text.alias("text")).dropDuplicates(["digest"])
    return nodes.join(said, "digest", "left")


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ids that follow each other in a class, joined; rows are sorted by class and id."""
    for batch in batches:
        of, ids = (batch.column(n).to_numpy(zero_copy_only=False) for n in ("class", "conv_id"))
        cuts = [0, *(np.flatnonzero(of[1:] != of[:-1]) + 1).tolist(), len(of)]
        parts = [(a, b) for a, b in zip(cuts, cuts[1:]) if b > a]
        text = [",".join(map(str, ids[a:b].tolist())) for a, b in parts]
        yield pa.RecordBatch.from_arrays([pa.array([int(of[a]) for a, _ in parts], pa.int64()), pa.array([int(ids[a]) for a, _ in parts], pa.int64()), pa.array(text, pa.string())], names=["class", "first", "ids"])


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The SHA-256 of each class's joined ids, of rows sorted by class and first id; one row is held at a time."""
    of, state = None, None

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([of], pa.int64()), pa.array([state.hexdigest()], pa.string())], names=["class", "ends_sha256"])

    for batch in batches:
        for own, ids in zip(batch.column("class").to_pylist(), batch.column("ids").to_pylist()):
            if own != of:
                if state is not None:
                    yield out()
                of, state = own, hashlib.sha256()
            else:
                state.update(b",")
            state.update(ids.encode())
    if state is not None:
        yield out()


def ends_digests(members: DataFrame) -> DataFrame:
    """``class, ends_sha256`` of ``members(conv_id, class)``: the SHA-256 of the class's ids, ascending, joined by commas.

    A digest reads its ids one after another, however many there are.  They are sorted and joined in many tasks, so the one that
    makes a class's digest is only passed some thousands of ids a row, and holds one row.
    """
    sizes = members.groupBy("class").agg(F.count("*").alias("n"))
    alone = sizes.where("n = 1").select("class", F.sha2(F.col("class").cast("string").cast("binary"), 256).alias("ends_sha256"))
    many = members.join(sizes.where("n > 1").select("class"), "class").select("class", "conv_id")
    chunks = many.repartitionByRange("class", "conv_id").sortWithinPartitions("class", "conv_id").mapInArrow(_joined, "class long, first long, ids string")
    hashed = chunks.repartition("class").sortWithinPartitions("class", "first").mapInArrow(_hashed, "class long, ends_sha256 string")
    return alone.unionByName(hashed)


def rebuilt(paths: DataFrame) -> DataFrame:
    """``paths`` as the query's contract wants them: the first turns are those of the first conversation of each ``BLOCK`` ids."""
    heads = paths.where(F.col("conv_id") % BLOCK == 0).select(F.col("conv_id").alias("_base"), F.slice("path", 1, MOST - 1).alias("_head"))
    rows = paths.withColumn("_base", F.col("conv_id") - F.col("conv_id") % BLOCK).join(heads, "_base", "left")
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % MOST).cast("int")
    own = F.slice("path", F.col("_h") + 1, F.size("path"))
    return rows.withColumn("_h", h).select("conv_id", F.when(F.col("_head").isNull(), own).otherwise(F.concat(F.slice("_head", F.lit(1), F.col("_h")), own)).alias("path"))


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nodes of the trie of all rebuilt conversations, with the digest of those that end there; see ``paths`` and ``trie`` for the edge cases."""
    nodes, members = trie(rebuilt(paths(table(spark, sf_dir, "conversations"))))
    ended = F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256")
    return nodes.join(ends_digests(members), "class", "left").select("conv_id", F.col("depth").cast("long").alias("depth"), "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", ended)


OP12_SQL = f"""
WITH RECURSIVE bits AS (
  SELECT range AS i, range AS c, 0 AS k FROM range(256) UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8
), crc AS (SELECT list(c ORDER BY i) AS tab FROM bits WHERE k = 8
), turns AS (
  SELECT conv_id, turn, length(coalesce(text, '')) AS size, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))[1:32] AS d FROM conversations WHERE conv_id IS NOT NULL
), own AS (SELECT conv_id, list(d ORDER BY turn NULLS FIRST, d) AS ds, list(size ORDER BY turn NULLS FIRST, d) AS sizes FROM turns GROUP BY conv_id
), hashed AS (
  SELECT own.*, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: ascii(x)::BIGINT)),
                lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295::BIGINT) % {MOST} AS h FROM own, crc
), built AS (
  SELECT a.conv_id, list_concat(coalesce(b.ds, [])[1:h], a.ds[h + 1:]) AS ds, list_concat(coalesce(b.sizes, [])[1:h], a.sizes[h + 1:]) AS sizes
  FROM hashed a LEFT JOIN own b ON b.conv_id = a.conv_id - a.conv_id % {BLOCK}
), prefixes AS (
  SELECT conv_id, d, len(ds) = d AS ended, md5(array_to_string(ds[1:d], ',')) AS k, md5(array_to_string(ds[1:d - 1], ',')) AS up, CASE WHEN d = 0 THEN 0 ELSE sizes[d] END AS size
  FROM (SELECT *, unnest(range(len(ds) + 1)) AS d FROM built)
), nodes AS (
  SELECT d, k, min(CASE WHEN d > 0 THEN up END) AS up, min(conv_id) AS conv_id, count(*) AS n_convs, min(size) AS size, coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE ended), '') AS ends FROM prefixes GROUP BY d, k
), kids AS (SELECT d - 1 AS d, up AS k, count(*) AS n FROM nodes WHERE d > 0 GROUP BY ALL
), full_nodes AS (SELECT n.*, coalesce(kids.n, 0) AS n_children FROM nodes n LEFT JOIN kids ON kids.d = n.d AND kids.k = n.k
), sums AS (
  SELECT p.d, p.k, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum((n_convs - 1) * n.size) AS saved_tokens
  FROM full_nodes n JOIN prefixes p ON p.conv_id = n.conv_id AND p.d <= n.d GROUP BY p.d, p.k
)
SELECT n.conv_id, n.d AS depth, u.conv_id AS parent_conv_id, n.n_convs, n.n_children, CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, sha256(n.ends) AS ends_sha256
FROM full_nodes n JOIN sums s ON s.d = n.d AND s.k = n.k LEFT JOIN nodes u ON u.d = n.d - 1 AND u.k = n.up"""
