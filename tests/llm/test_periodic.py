"""Periodic runs against brute force, and their edge cases."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from victual.llm import periodic
from tests.llm.test_operators import CLASHING, clashing, docs, prose


def slow_runs(words):
    out = []
    for q in range(1, len(words) // 4 + 1):
        i = 0
        while i < len(words) - q:
            j = i
            while j < len(words) - q and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            own = words[i : i + length]
            if j > i and length >= max(6, 4 * q) and not any(own[p:] == own[:-p] for p in range(1, q)):
                out.append((i, length, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def slow_collapse(words, runs):
    return [w for i, w in enumerate(words) if not any(s + q <= i < s + n for s, n, q in runs)]


def numbers(words):
    ids = {}
    return np.array([ids.setdefault(w, len(ids)) for w in words], np.int64)


def patchy(draw, n, kinds):
    words = []
    while len(words) < n:
        block = [draw.randrange(kinds) for _ in range(draw.randint(1, 6))]
        words += block * (1 if draw.random() < 0.5 else draw.randint(2, 9))
    return words[:n]


@pytest.mark.parametrize("pairs", [1, 7, 1 << 20])
def test_runs_against_brute_force(pairs, monkeypatch):
    monkeypatch.setattr(periodic, "PAIRS", pairs)
    draw = random.Random(pairs)
    for _ in range(600):
        words = patchy(draw, draw.randint(0, 90), draw.choice([1, 2, 2, 3, 5]))
        assert periodic.find_runs(numbers(words)) == slow_runs(words)


def test_counts_of_frequent_and_rare_words():
    draw = np.random.default_rng(5)
    words = numbers(np.minimum(draw.zipf(1.3, 6000), 900).tolist())
    sizes = np.bincount(words)
    assert sizes.max() > 1500 and (sizes < 5).sum() > 50  # both ways of counting are taken
    counts = periodic.count_matches(words)
    assert len(counts) == 1501
    assert all(counts[q] == (words[q:] == words[:-q]).sum() for q in range(1, 1501))


def test_long_periods_and_multiples():
    draw = random.Random(2)
    block = [draw.randrange(2) for _ in range(211)]
    words = [draw.randrange(2) for _ in range(500)] + block * 5 + block[:30] + [7] + [3, 4] * 400
    runs = periodic.find_runs(numbers(words))
    assert runs == slow_runs(words)
    assert any(r[2] == 211 for r in runs) and [r for r in runs if r[1] > 700 and r[2] == 2] == [(1586, 800, 2)]


def test_texts_that_are_one_long_run():
    assert periodic.find_runs(np.zeros(300_000, np.int64)) == [(0, 300_000, 1)]
    two = np.random.default_rng(0).integers(0, 2, 20_000)
    assert {r for r in periodic.find_runs(two) if r[2] < 4} == {r for r in slow_runs(two.tolist()[:3000]) if r[2] < 4 and r[0] < 2900} | {r for r in periodic.find_runs(two) if r[2] < 4 and r[0] >= 2900}


def test_runs_of_documents_and_edges(spark):
    rows = [
        (1, "a b  a\tb a b\na b x", "s"), (2, None, None), (3, "", "s"), (4, " \n ", "s"), (5, "w " * 5, "s"), (6, "w " * 6, "s"), (6, "w " * 6, "s"),
        (None, "é É é É é É é É", "s"), (8, "x" * 300_000 + " y", "s"), (9, prose(1, 20_000) + " u v" * 10, "s"),
    ]
    found = {}
    for r in periodic.periodic_runs(clashing(docs(spark, *rows))).collect():
        found.setdefault(r["doc_id"], []).append(r)
    assert sum(map(len, found.values())) == len(rows)
    assert [tuple(x) for x in found[1][0]["runs"]] == [(0, 8, 2)] and found[1][0]["collapsed"] == "a b x"
    for i in (2, 3, 4):
        assert (found[i][0]["n_words"], found[i][0]["runs"], found[i][0]["collapsed"]) == (0, [], "")
    assert found[5][0]["runs"] == [] and found[5][0]["collapsed"] == "w w w w w"
    assert [x["collapsed"] for x in found[6]] == ["w", "w"]
    assert found[None][0]["collapsed"] == "é É" and found[8][0]["n_words"] == 2
    assert [tuple(x) for x in found[9][0]["runs"]][-1] == (20_000, 20, 2)
    assert periodic.periodic_runs(docs(spark).limit(0)).count() == 0
    assert CLASHING[0] not in periodic.periodic_runs(clashing(docs(spark, *rows))).columns


def slow_rows(doc_id, text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]
    if doc_id is not None and words and (h := zlib.crc32(str(doc_id).encode())) % 10 == 0:
        n, g = len(words), h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = slow_runs(words)
    start, length, period = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None, None, None)
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (
        doc_id, len(runs), start, length, period, None if not runs else 1000 * length // period,
        digest("".join(f"{s},{n},{q}\n" for s, n, q in runs)), digest(" ".join(slow_collapse(words, runs))),
    )


def test_query_against_brute_force(spark, tmp_path):
    draw = random.Random(4)
    rows = [(i, " ".join(f"w{x}" for x in patchy(draw, draw.randint(0, 120), 4)), "s") for i in range(150)]
    rows += [(200 + i, prose(i, draw.randint(1, 150)), "s") for i in range(100)] + [(400, None, "s"), (401, "", "s"), (None, "a b c d", "s"), (3, "again", None)]
    docs(spark, *rows).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = periodic.op11_periodic_runs(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert dict(got.dtypes)["n_runs"] == "bigint" and dict(got.dtypes)["exponent_milli"] == "bigint"
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(map(tuple, got.collect()), key=key) == sorted((slow_rows(i, t) for i, t, _ in rows), key=key)
    assert got.where("n_runs > 0").count() > 100
    assert any(zlib.crc32(str(i).encode()) % 10 == 0 for i, _, _ in rows if i is not None)
    assert not any("Exchange" in line for line in got._jdf.queryExecution().executedPlan().toString().splitlines())
