"""MinHash near-duplicates against brute force, and their edge cases."""

import random
from itertools import combinations

import numpy as np
import pytest

from victual.llm import components, minhash
from tests.llm.test_operators import clashing, docs, edited, prose


def slow_set(text, size):
    words = (text or "").encode().lower().split()
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1)))


def slow_components(rows, size):
    """``(doc_id, number of shingles, component, kept)`` of each row."""
    sets = [slow_set(t, size) for _, t, _ in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in combinations(range(len(rows)), 2):
        a, b = sets[i], sets[j]
        if a and b and 100 * len(a & b) >= 80 * len(a | b):
            root[find(i)] = find(j)
    least = {}
    for i, (doc, _, _) in enumerate(rows):
        if doc is not None:
            least[find(i)] = min(doc, least.get(find(i), doc))
    out = [(doc, len(sets[i]), least.get(find(i))) for i, (doc, _, _) in enumerate(rows)]
    return sorted((repr((d, n, c, d == c)) for d, n, c in out))


def found(spark, rows, size=4, block=1024):
    got = minhash.near_duplicates(clashing(docs(spark, *rows)).repartition(3), size, block)
    return sorted(repr((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"])) for r in got.collect())


def group(seed, copies, words, most):
    base, draw = prose(seed, words), random.Random(seed)
    return [base] + [edited(base, seed * 1000 + k, draw.randint(1, most)) for k in range(copies)]


@pytest.mark.parametrize("size,block", [(4, 1024), (5, 4)])
def test_against_brute_force(spark, size, block, monkeypatch):
    if block == 4:  # so that lists have many blocks and texts pass by in many copies
        monkeypatch.setattr(minhash, "HELD", 2)
        monkeypatch.setattr(minhash, "PASSING", 3)
    texts = group(1, 60, 150, 12) + group(2, 30, 60, 5) + group(3, 20, 400, 12)
    texts += [t for k in range(20) for t in group(10 + k, 1, 90, 6)]
    texts += [prose(100, 40) + " " + prose(200 + k, 60) for k in range(20)]  # a passage that many share
    texts += [t.upper().replace(" ", "\n \t") for t in texts[:5]] + texts[:7]
    order = list(range(len(texts)))
    random.Random(3).shuffle(order)
    rows = [(i, texts[k], "s") for i, k in enumerate(order)]
    got = found(spark, rows, size, block)
    assert got == slow_components(rows, size)
    assert sum("False" in r for r in got) > 40


def test_edges(spark):
    long = prose(9, 30_000)
    rows = [
        (5, "a b c", "s"), (2, "A  b\nc", "s"), (9, "a b c d", "s"), (3, None, "s"), (4, "", "s"), (1, " \n", "s"), (None, "a b c", "s"), (None, "only one", None),
        (7, "x" * 200_000, "s"), (6, long, "s"), (8, long + " end", "s"), (2, "A  b\nc", "s"), (2, "another text than the one above", "s"), (11, "É b c", "s"), (12, "é b c", "s"), (3, None, "s"),
    ]
    got = found(spark, rows)
    assert got == slow_components(rows, 4)
    assert repr((None, 1, None, True)) in got and repr((5, 1, 2, False)) in got and repr((8, 29_998, 6, False)) in got
    assert minhash.near_duplicates(docs(spark)).count() == 0
    assert minhash.near_duplicates(docs(spark, (1, None, "s"))).collect()[0]["kept"]


def test_a_crowd_of_equal_texts(spark):
    rows = [(i, "the same words in each of these texts", "s") for i in range(300, 0, -1)] + [(0, "other words stand in this one", "s")]
    got = minhash.near_duplicates(docs(spark, *rows), 4).where("kept").collect()
    assert sorted(r["doc_id"] for r in got) == [0, 1]


def test_minima_and_keys():
    sets = [minhash.shingles(prose(k, 500).encode()) for k in range(2)]
    a, b = np.unique(np.r_[sets[0], sets[1][:50]]), sets[0]
    least = minhash.minima(a), minhash.minima(b)
    folded = [(int(x) >> 32) for x in a]
    for k in (0, 7, 239):
        assert least[0][k] == min((x * int(minhash._TIMES[k]) + int(minhash._PLUS[k])) % (1 << 32) for x in folded)
    alike = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    same = np.mean(least[0] == least[1])
    assert abs(same - alike) < 0.1
    marks = [np.frombuffer(minhash.signature(x), np.uint8) for x in least]
    assert (marks[0] == marks[1]).sum() >= (least[0] == least[1]).sum()
    keys = [minhash.band_keys(x) for x in least]
    bands = (least[0] == least[1]).reshape(minhash.BANDS, minhash.ROWS).all(axis=1)
    assert ((keys[0] == keys[1]) == bands).all() and len(set(keys[0])) == minhash.BANDS
    assert (minhash.minima(np.concatenate([a] * 3)) == least[0]).all()


def test_bands_miss_next_to_nothing():
    """The chance that a pair at the bound shares no band, and that its estimate falls below what goes on."""
    assert (1 - 0.8**minhash.ROWS) ** minhash.BANDS < 1e-8
    draw, missed = np.random.default_rng(1), 0
    for k in range(300):
        n = int(draw.integers(20, 400))
        common = draw.integers(0, 1 << 63, 8 * n, dtype=np.uint64)
        pair = [minhash.minima(np.unique(np.r_[common, draw.integers(0, 1 << 63, n, dtype=np.uint64)])) for _ in range(2)]
        missed += not (minhash.band_keys(pair[0]) == minhash.band_keys(pair[1])).any()
    assert missed == 0


def test_no_pairs_read_no_texts(spark):
    """A round that has nothing to confirm ends there: neither texts nor classes are looked at."""
    pairs = spark.createDataFrame([], "a long, b long, of long")
    got = minhash.confirm(None, None, pairs, 4)
    assert got.columns == ["a", "b"] and got.isEmpty()


def test_plans_stay_small(spark, monkeypatch):
    """No single job has many exchanges: the driver holds all the stages of one at once."""
    most = {}

    def counting(df, name, written=minhash.written):
        plan = df._jdf.queryExecution().executedPlan().toString()
        most[name] = max(most.get(name, 0), plan.count("Exchange"))
        return written(df, name)

    monkeypatch.setattr(minhash, "written", counting)
    monkeypatch.setattr(components, "written", counting)
    texts = group(1, 12, 150, 12) + group(2, 6, 60, 5) + [prose(300 + k, 50) for k in range(5)]
    rows = [(k, t, None) for k, t in enumerate(texts)]
    assert found(spark, rows) == slow_components(rows, 4)
    assert most["edges"] <= 4 and most["links"] <= 9 and most["candidates"] <= 9
