"""Prefix tries of conversations against brute force, and their edge cases."""

import hashlib
import random
import zlib

import duckdb
import pytest

from victual.llm import tries
from tests.llm.test_operators import clashing

TURNS = "conv_id long, turn long, role string, text string"


def conversations(spark, rows):
    return spark.createDataFrame(rows, TURNS)


def ordered(rows):
    """Role and text of each conversation's turns, in order; those of one number by digest."""
    digest = lambda role, text: hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()
    out = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            out.setdefault(conv, []).append((turn is not None, turn or 0, digest(role or "", text or ""), role or "", text or ""))
    return {c: [t[3:] for t in sorted(ts)] for c, ts in out.items()}


def rebuilt(convs):
    out = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = convs.get(c - c % 100, [])[:h] + own[h:]
    return out


def slow_trie(convs):
    members = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    rows = []
    for node, ids in members.items():
        under = [k for k in members if k[: len(node)] == node]
        ends = ",".join(map(str, sorted(c for c in ids if len(convs[c]) == len(node))))
        rows.append((
            min(ids), len(node), min(members[node[:-1]]) if node else None, len(ids), sum(len(k) == len(node) + 1 for k in under),
            sum(not any(m != k and m[: len(k)] == k for m in under) for k in under), sum((len(members[k]) - 1) * len(k[-1][1]) for k in under if k), hashlib.sha256(ends.encode()).hexdigest(),
        ))
    return sorted(rows, key=repr)


def found(nodes, members):
    ends = {r["class"]: r["ends_sha256"] for r in tries.ends_digests(members).collect()}
    empty = hashlib.sha256(b"").hexdigest()
    return sorted((
        (r["conv_id"], r["depth"], r["parent_conv_id"], r["n_convs"], r["n_children"], r["n_leaves"], r["saved_tokens"], ends.get(r["class"], empty)) for r in nodes.collect()
    ), key=repr)


def bushy(seed, n):
    draw, rows = random.Random(seed), []
    for c in range(n):
        turns = [draw.choice("ab") * draw.choice([1, 1, 1, 2]) for _ in range(draw.choice([1, 2, 3, 5, 9]))]
        if draw.random() < 0.6:
            turns = ["common", "beginning"] + turns  # a first turn that most have
        rows += [(c, k, "user" if k % 2 == 0 else None, t) for k, t in enumerate(turns)]
    draw.shuffle(rows)
    return rows


@pytest.mark.parametrize("limit", [1, 7, 60, 10_000])
def test_against_brute_force(spark, limit):
    rows = bushy(3, 120) + [(500, k, "user", f"long {k}") for k in range(90)] + [(501, k, "user", f"long {k}") for k in range(70)]
    nodes, members = tries.trie(tries.paths(clashing(conversations(spark, rows)).repartition(3)), limit)
    assert found(nodes, members) == slow_trie(ordered(rows))
    assert sorted(r["conv_id"] for r in members.collect()) == sorted({r[0] for r in rows})


def test_edges(spark):
    rows = [
        (1, None, None, None), (1, 2, "user", "b"), (2, None, "", ""), (2, 2, "user", "b"), (3, 1, "use", "rb"), (3, 1, "user", "b"), (None, 1, "user", "lost"), (4, 1, "user", "x" * 300_000),
        (5, 1, "user", "b"), (5, 1, "user", "b"), (6, 1, "user", "é\n👍"), (7, 1, "user", "é\n👍"), (-5, 3, "user", "b"),
    ]
    nodes, members = tries.trie(tries.paths(conversations(spark, rows)))
    slow = slow_trie(ordered(rows))
    assert found(nodes, members) == slow
    said = {(r["conv_id"], r["depth"]): (r["role"], r["text"]) for r in tries.with_texts(nodes, conversations(spark, rows)).collect()}
    assert said[-5, 0] == (None, None) and said[1, 1] == ("", "") and said[6, 1] == ("user", "é\n👍") and len(said) == len(slow)
    nodes, members = tries.trie(tries.paths(conversations(spark, [])))
    assert nodes.count() == 0 and members.count() == 0 and tries.ends_digests(members).count() == 0


def test_conversations_without_turns(spark):
    paths = tries.paths(conversations(spark, [(1, 0, "user", "a"), (2, 0, "user", "a")])).selectExpr("conv_id", "slice(path, 1, 0) as path")
    nodes, members = tries.trie(paths)
    assert found(nodes, members) == [(1, 0, None, 2, 0, 1, 0, hashlib.sha256(b"1,2").hexdigest())]


def test_a_class_of_many_members(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "500")
    members = spark.range(0, 5000).selectExpr("9998 - 2 * id as conv_id", "0L as class").repartition(4)
    got = tries.ends_digests(members).collect()
    assert [r["ends_sha256"] for r in got] == [hashlib.sha256(",".join(map(str, range(0, 9999, 2))).encode()).hexdigest()]


def test_query_against_brute_force_and_sql(spark, tmp_path):
    rows = [(c * 7 % 900, k, r, t) for c, k, r, t in bushy(5, 150)] + [(200, 0, "user", "only")]
    conversations(spark, rows).repartition(2).write.parquet(f"{tmp_path}/conversations.parquet")
    got = tries.op12_conversation_trie(spark, str(tmp_path))
    assert dict(got.dtypes)["depth"] == "bigint"
    want = slow_trie(rebuilt(ordered(rows)))
    assert sorted(map(tuple, got.collect()), key=repr) == want
    with duckdb.connect() as db:
        db.sql(f"CREATE VIEW conversations AS FROM '{tmp_path}/conversations.parquet/*.parquet'")
        assert sorted(db.sql(tries.OP12_SQL).fetchall(), key=repr) == want
