"""Operators against brute force, and their edge cases."""

import gzip
import hashlib
import io
import random
import re
import textwrap
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from victual.llm import ann, classifier, common, components, licences, lines, minhash, mixing, packing, rules, simhash, urls, warc
from victual.llm.common import shared_folder

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that the operators use inside.
CLASHING = ("fp", "size", "taken", "bucket", "score", "_text", "_spans", "key", "skey", "label", "words")


def docs(spark, *rows):
    return spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], DOCS)


def clashing(df):
    return df.withColumns({c: F.lit("x") for c in CLASHING})


def prose(seed, n):
    draw = random.Random(seed)
    return " ".join("".join(draw.choices("abcdefgh", k=draw.randint(2, 7))) for _ in range(n))


# -------------------------------------------------------------------- common


def test_work_folders(spark, monkeypatch):
    table = common.written(spark.range(3).toDF("id"), "three")
    assert table.count() == 3
    path = next(p for p in common._made if "/three-" in p)
    kept = {p: s for p, s in common._made.items() if p != path}
    for p in kept:
        del common._made[p]
    assert common.remove_work() == 1 and path not in common._made
    common._made.update(kept)
    with pytest.raises(Exception, match="(?i)PATH_NOT_FOUND|does not exist"):
        spark.read.parquet(path)

    class Cluster:
        class conf:
            get = staticmethod(lambda key, default=None: default)

        class sparkContext:
            master, getCheckpointDir = "spark://host:7077", staticmethod(lambda: None)

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.shared_folder(Cluster, "x")


def test_batches_are_only_made_smaller(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    for now, after in (("10000", "2000"), ("0", "2000"), ("50", "50")):
        spark.conf.set(key, now)
        common.bounded_batches(spark)
        assert spark.conf.get(key) == after
    spark.conf.set(key, before)


def test_marked_rows_are_never_missed(spark):
    rows = spark.range(3000).toDF("id")
    keys = rows.where("id % 7 = 0").select(F.xxhash64("id").alias("_h"))
    marked, found = common.may_be_in(rows, F.xxhash64("id"), keys)
    hits = {r.id for r in marked.where(found).collect()}
    assert hits >= set(range(0, 3000, 7)) and len(hits) < 500
    marked, found = common.may_be_in(rows, F.xxhash64("id"), keys.where("false"))
    assert marked.where(found).count() == 0 and marked.where(~found).count() == 3000


# ---------------------------------------------------------------- components


def test_components_of_random_graphs(spark):
    draw = random.Random(3)
    edges = [(draw.randrange(60), draw.randrange(60)) for _ in range(45)] + [(i, i + 1) for i in range(100, 140)] + [(5, 5)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    want = {x: find(x) for e in edges if e[0] != e[1] for x in e}
    got = components.components(spark.createDataFrame([*edges, (None, 1)], "a long, b long"))
    assert {r.node: r.root for r in got.collect()} == want
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


# ------------------------------------------------------------------- simhash


def slow_fingerprint(text):
    low = "".join(c.lower() if c.isascii() else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    grams = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def slow_groups(prints):
    ids = sorted(prints)
    group = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for a, b in combinations(ids, 2):
            if (prints[a] ^ prints[b]).bit_count() <= 4 and group[a] != group[b]:
                low = min(group[a], group[b])
                group[a] = group[b] = low
                changed = True
    return group


def test_any_four_positions_hold_a_triple():
    assert len(simhash.TRIPLES) == 20
    assert all(any(set(t) <= set(four) for t in simhash.TRIPLES) for four in combinations(range(8), 4))


def test_near_duplicates_against_brute_force(spark):
    texts = {i: prose(i, 80) for i in range(0, 40, 2)}
    texts |= {i + 1: texts[i] + (" tail" if i % 4 else "") for i in range(0, 20, 2)}
    texts |= {50: None, 51: "", 52: " \n", 53: "one", 54: "ONE", 55: "Éa É a\x0bb\u00a0c", 56: prose(7, 3)}
    table = clashing(docs(spark, *[(i, t, "s") for i, t in texts.items()]))
    got = {r.doc_id: r for r in simhash.near_duplicates(table).collect()}
    prints = {i: slow_fingerprint(t) for i, t in texts.items()}
    assert {i: int(r.fingerprint, 16) for i, r in got.items()} == prints and all(len(r.fingerprint) == 16 for r in got.values())
    assert {i: r.component_id for i, r in got.items()} == slow_groups(prints)
    assert simhash.near_duplicates(docs(spark)).count() == 0


def test_fingerprint_of_a_very_long_text():
    """Over 32,768 shingles, so in several slices."""
    draw = random.Random(12)
    text = " ".join(draw.choices(["a", "b", "cd", "e"], k=80_000))
    assert simhash.fingerprint(text.encode()) == slow_fingerprint(text)


@pytest.mark.parametrize("block", [3, 1024])
def test_links_of_crowded_lists(spark, block):
    """Fingerprints that agree in many bytes: long lists, cut into blocks or not."""
    draw = random.Random(1)
    base = draw.getrandbits(64)
    prints = {base ^ sum(1 << b for b in draw.sample(range(64), draw.randint(0, 7))) for _ in range(150)} | {draw.getrandbits(64) for _ in range(50)}
    prints = dict(enumerate(sorted(prints)))
    signed = {i: p - (1 << 64) if p >> 63 else p for i, p in prints.items()}
    found = simhash.links(spark.createDataFrame([(p,) for p in signed.values()], "fp long"), block)
    got = {r.node: r.root for r in components.components(found).collect()}
    want = slow_groups(prints)
    by_root = lambda root: {frozenset(k for k, v in root.items() if v == r) for r in set(root.values())}
    assert by_root({i: got.get(p, p) for i, p in signed.items()}) == by_root(want)


def test_work_of_a_long_list_follows_its_length(spark):
    """Fingerprints that share three bytes and nothing else: what is dealt grows as their number, and no link is lost."""
    dealt = {}
    for n in (2000, 8000):
        draw = np.random.default_rng(n)
        fps = np.unique(np.uint64(0xABCDEF) << np.uint64(40) | draw.integers(0, 1 << 40, n, np.uint64))
        table = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
        dealt[n] = simhash.deal(simhash.split_lists(table, 128), 128).count()
    assert dealt[8000] < 6 * dealt[2000]


def test_lists_are_split_without_loss(spark):
    """Each pair of up to four differing bits shares a list at every depth of splitting."""
    draw = random.Random(8)
    base = draw.getrandbits(64)
    shapes = [draw.sample(range(64), 4) for _ in range(40)] + [[8 * a + draw.randrange(8) for a in draw.sample(range(8), 4)] for _ in range(40)] + [[8 * draw.randrange(8) + k for k in range(4)] for _ in range(5)]
    pairs = [(base ^ (k << 32), base ^ (k << 32) ^ sum(1 << b for b in bits)) for k, bits in enumerate(shapes)]
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    table = spark.createDataFrame([(signed(x),) for x in {x for pair in pairs for x in pair}], "fp long")
    for block in (1, 20, 10_000):
        held = {}
        for r in simhash.split_lists(table, block).collect():
            held.setdefault(r.fp, set()).add(r.list)
        assert all(held[signed(a)] & held[signed(b)] for a, b in pairs), block


def test_long_lists_in_slices():
    draw = np.random.default_rng(5)
    fps = np.uint64(12345) ^ (np.uint64(1) << draw.integers(0, 64, 300, np.uint64))
    fps = np.unique(np.r_[fps, draw.integers(0, 1 << 63, 200, np.uint64)])
    keys = np.zeros(len(fps), np.int64)
    a, b = simhash.link_lists(keys, fps)
    want = slow_groups(dict(enumerate(map(int, fps))))
    assert len(a) == sum(k != v for k, v in want.items()) and all(int(x) != int(y) for x, y in zip(a, b))


def test_keep_one(spark):
    same = prose(1, 60)
    table = clashing(docs(spark, (3, same, "a"), (1, same, "b"), (1, same, "b"), (9, prose(2, 60), "a"), (None, same, "a")))
    kept = simhash.keep_one(table)
    assert kept.columns == table.columns
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect()) == [(False, 1), (False, 9), (True, 0)]


def test_keep_one_of_repeated_ids(spark):
    """Rows that share an id but not their text are of different components."""
    a, b = prose(1, 60), prose(2, 60)
    table = docs(spark, (3, b, "s"), (5, a, "s"), (5, b, "s"), (7, a, "s"), (8, None, "s"), (9, "", "s"))
    assert sorted((r.doc_id, r.text) for r in simhash.keep_one(table).collect()) == sorted([(3, b), (5, a), (8, None)], key=str)
    assert simhash.keep_one(docs(spark)).count() == 0


# --------------------------------------------------------------- near copies


def shingles_of(text, size=5):
    low = "".join(c.lower() if c.isascii() else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    return {tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))} if words else set()


def similarity(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def alike_groups(texts, least=0.8):
    """The smallest key reachable over pairs of a similarity of ``least``."""
    sets, group = {i: shingles_of(t) for i, t in texts.items()}, {i: i for i in texts}
    for a, b in combinations(sorted(texts), 2):
        if group[a] != group[b] and similarity(sets[a], sets[b]) >= least:
            low, high = sorted((group[a], group[b]))
            group = {i: low if g == high else g for i, g in group.items()}
    return group


def edited(text, seed, n):
    """The text with ``n`` of its words changed."""
    draw, words = random.Random(seed), text.split(" ")
    for at in draw.sample(range(len(words)), n):
        words[at] = f"new{draw.random()}"
    return " ".join(words)


@pytest.mark.parametrize("block", [4, 1024])
def test_groups_by_shingles(spark, block):
    """Near copies of one text, whose lists are cut into blocks or not, and texts that share less."""
    base = prose(1, 300)
    texts = {i: edited(base, i, 1 + i % 2) for i in range(30)}
    texts |= {30 + i: edited(base, i, 60) for i in range(5)} | {40 + i: prose(40 + i, 200) for i in range(10)}
    texts |= {60 + i: prose(40 + i, 200).upper() + "\n" for i in range(4)} | {70: None, 71: "", 72: " \n", 73: "one", 74: "ONE", 75: "two", 76: "one two", 77: "Éa", 78: "éa"}
    rows, placed = minhash.by_shingles(clashing(docs(spark, *[(i, t, "s") for i, t in texts.items()])), block=block)
    roots = {r.doc_id: r.root for r in rows.join(placed, "fp").collect()}
    least = {root: min(i for i in roots if roots[i] == root) for root in set(roots.values())}
    worded = {i: t for i, t in texts.items() if t and t.split()}
    assert {i: least[root] for i, root in roots.items()} == alike_groups(worded) and len(worded) == len(texts) - 3
    assert minhash.by_shingles(docs(spark))[0].count() == 0


def test_keep_one_by_shingles(spark):
    """Ties, repeated rows and ids, rows without doc_id, extra columns."""
    a, b = prose(1, 200), prose(2, 200)
    table = clashing(docs(spark, (3, b, "s"), (5, edited(a, 1, 2), "s"), (5, edited(b, 1, 2), "s"), (7, a, "s"), (7, a, "s"), (None, a, "s"), (8, None, "s"), (9, "", "s")))
    kept = simhash.keep_one(table, minhash.by_shingles)
    assert kept.columns == table.columns
    assert sorted((r.doc_id or 0, r.text) for r in kept.collect()) == sorted([(0, a), (3, b), (5, edited(a, 1, 2)), (8, None), (9, "")], key=str)
    assert simhash.keep_one(docs(spark), minhash.by_shingles).count() == 0


# ---------------------------------------------------------------- line dedup


def slow_dedup(table, least):
    """All windows of all texts, in order: a line goes if a window over it has begun earlier elsewhere."""
    seen, out = {}, {}
    rows = []
    for doc_id, text in sorted(table):
        ls = text.split("\n")
        some = [i for i, x in enumerate(ls) if x.split()]
        count = [len(ls[i].split()) for i in some]
        for a in range(len(some)):
            for b in range(a, len(some)):
                inner = sum(count[a : b + 1])
                if inner >= least and (inner - count[a] < least or inner - count[b] < least):
                    key = tuple(" ".join(ls[i].lower().split()) for i in some[a : b + 1])
                    place = (doc_id, some[a])
                    seen[key] = min(seen.get(key, place), place)
                    rows.append((key, place, some[a], some[b]))
    gone = {}
    for key, place, first, last in rows:
        if seen[key] != place:
            gone.setdefault(place[0], set()).update(range(first, last + 1))
    for doc_id, text in table:
        out[doc_id] = "\n".join(x for i, x in enumerate(text.split("\n")) if i not in gone.get(doc_id, ()) or not x.strip())
    return out


@pytest.mark.parametrize("seed", range(3))
def test_line_dedup_against_brute_force(spark, seed):
    draw = random.Random(seed)
    pool = [prose(1000 + i, draw.choice([1, 2, 3, 6, 12])) for i in range(14)] + [""]
    table = [(i, "\n".join(draw.choices(pool, k=draw.randint(1, 14)))) for i in range(25)]
    found = lines.dedup_lines(docs(spark, *[(i, t, "s") for i, t in table]), least=10).collect()
    want = slow_dedup(table, 10)
    assert {r.doc_id: r.text for r in found} == want
    assert any(r.lines_deleted for r in found)


def test_every_repeated_run_loses_its_later_copies(spark):
    """A run of over 50 words, whole or in several lines, wherever it stands."""
    run = "\n".join(prose(i, 13) for i in range(5))
    long_line = prose(99, 70)
    table = docs(
        spark, (1, f"{prose(1, 20)}\n{run}\n{prose(2, 20)}", "s"), (2, f"{run}\nshort\n{long_line}", "s"), (3, f"{prose(3, 9)}\n{long_line.upper()}\n{prose(4, 9)}", "s"),
        (4, prose(5, 20) + "\n" + prose(1, 20), "s"),
    )
    left = {r.doc_id: r for r in lines.dedup_lines(table).collect()}
    assert left[1].lines_deleted == 0 and left[2].text == f"short\n{long_line}" and left[3].text == f"{prose(3, 9)}\n{prose(4, 9)}"
    assert left[4].lines_deleted == 0  # 20 words are no run
    assert left[2].n_chars == len(left[2].text)


def slow_passages(table, least):
    """Words left of each text: a word goes if a window of ``least`` words over it has stood earlier."""
    seen, out = set(), {}
    for doc_id, text in sorted(table):
        words, gone = text.lower().split(), set()
        for at in range(len(words) - least + 1):
            if (key := tuple(words[at : at + least])) in seen:
                gone.update(range(at, at + least))
            seen.add(key)
        out[doc_id] = [w for k, w in enumerate(text.split()) if k not in gone]
    return out


def test_passages_that_begin_and_end_within_lines(spark):
    """Planted in mid-line, in one line, broken elsewhere, and too short by a word."""
    passage, other = prose(700, 60).split(), prose(701, 49)
    words = lambda seed, n: prose(seed, n)
    a, b, c = (" ".join(passage[i:j]) for i, j in ((0, 17), (17, 42), (42, 60)))
    table = [
        (1, f"{words(1, 8)}\n{words(2, 5)} {a}\n{b}\n{c} {words(3, 6)}\n{other}"),
        (2, f"{words(4, 9)} {a}\n{b}\n{c}  {words(5, 7)}\nlast"),  # two partial lines around a whole one
        (3, f"{words(6, 80)} {' '.join(passage).upper()} {words(7, 80)}"),  # within a long line
        (4, "\n".join([*passage[:30], " ".join(passage[30:]) + " tail"])),  # broken elsewhere
        (5, f"{words(8, 3)} {other} {words(9, 3)}"),  # 49 words
    ]
    left = {r.doc_id: r for r in lines.dedup_lines(docs(spark, *[(i, t, "s") for i, t in table])).collect()}
    assert {i: r.text.split() for i, r in left.items()} == slow_passages(table, 50)
    assert left[2].text == f"{words(4, 9)}\n{words(5, 7)}\nlast" and left[2].lines_deleted == 1
    assert left[3].text == f"{words(6, 80)} {words(7, 80)}" and left[4].text == "tail"
    assert left[5].text == table[4][1] and all(r.n_chars == len(r.text) for r in left.values())


@pytest.mark.parametrize("seed", range(2))
def test_passages_against_brute_force(spark, seed):
    draw = random.Random(seed)
    table = [(i, "".join(draw.choice("ab") + draw.choice([" ", " ", "\n"]) for _ in range(draw.randint(0, 60)))) for i in range(30)]
    left = lines.dedup_lines(docs(spark, *[(i, t, "s") for i, t in table]), least=9).collect()
    assert {r.doc_id: r.text.split() for r in left} == slow_passages(table, 9)


def test_bitmaps_follow_what_they_mark(spark, monkeypatch):
    """Full bitmaps cost comparisons, and larger ones nothing: the texts that are left are the same."""
    run = prose(500, 70)
    table = docs(spark, *[(i, f"{prose(i, 90)}\n{run if i % 2 else ''} {prose(1000 + i, 40)}", "s") for i in range(40)])
    left = {r.doc_id: r.text for r in lines.dedup_lines(table).collect()}
    rows = table.select(lines.utf8("text").alias("_text")).mapInArrow(lambda b: lines._stretches(b, 50), "fp long, stretch long")
    assert lines._marks(rows).shape == (2, lines.LEAST_MARKS >> 6)
    monkeypatch.setattr(lines, "LEAST_MARKS", 64)
    sized, many = lines._marks(rows).shape[1] * 64, rows.groupBy("fp").count().where("count > 1").count()
    assert lines.PER_MARK * many <= sized < 2 * lines.PER_MARK * many
    monkeypatch.setattr(lines, "MOST_MARKS", 64)
    assert lines._marks(rows).shape == (2, 1)
    assert {r.doc_id: r.text for r in lines.dedup_lines(table).collect()} == left
    assert {i: t.split() for i, t in left.items()} == slow_passages([(r.doc_id, r.text) for r in table.collect()], 50)


@pytest.mark.parametrize("least", [64, 1 << 12, 1 << 29])
def test_bitmaps_are_one_job(spark, monkeypatch, least):
    """Whatever their size, they hold the lowest bits of what occurs twice; no table is written for them."""
    monkeypatch.setattr(lines, "LEAST_MARKS", least)
    draw = random.Random(5)
    fps = [draw.getrandbits(64) - (1 << 63) for _ in range(90)]
    rows = [(fp, s) for k, fp in enumerate(fps) for s in ((7,), (7, 7), (-1, 8, 8))[k % 3]]
    before = set(common._made)
    marks = lines._marks(spark.createDataFrame(rows, "fp long, stretch long").repartition(5))
    assert set(common._made) == before
    bits = marks.shape[1] * 64
    assert bits == max(least, 1 << (lines.PER_MARK * 60 - 1).bit_length())
    for row, kinds in zip(marks, ((1, 2), (2,))):
        words = np.flatnonzero(row).tolist()
        assert {w * 64 + b for w in words for b in range(64) if int(row[w]) >> b & 1} == {fp & (bits - 1) for k, fp in enumerate(fps) if k % 3 in kinds}


def test_equal_digests_of_different_words(spark, monkeypatch):
    """Where the first digest says nothing, the check alone keeps different windows apart."""
    monkeypatch.setattr(lines, "_BASE", 1)  # sums of words: order doesn't matter
    words = prose(800, 60).split()
    turned = [*words[:20], words[21], words[20], *words[22:]]
    found = [lines.Passages([" ".join(x).encode()], 60) for x in (words, turned, [w.upper() for w in words])]
    yes = np.ones(1, bool)
    one, other, again = ([x.to_pylist()[0] for x in f.checked(yes, yes)] for f in found)
    assert one[0] == other[0] and one[1] != other[1] and one == again
    assert one[2:] == [[one[0]], [one[1]]]


def test_line_dedup_edges(spark):
    text = prose(1, 60)
    table = clashing(docs(spark, (1, None, "s"), (2, "", None), (None, text, "s"), (4, text, "s"), (4, text, "s"), (5, text, "s"), (6, f"{text}\n{text}", "s"), (4, "other", "s")))
    out = lines.dedup_lines(table)
    assert out.columns == [*table.columns, "lines_deleted"]
    rows = sorted(((r.doc_id or 0, r.text, r.lines_deleted, r.fp) for r in out.collect()), key=repr)
    assert rows == sorted([(1, None, 0, "x"), (2, "", 0, "x"), (0, text, 0, "x"), (4, text, 0, "x"), (4, text, 0, "x"), (5, "", 1, "x"), (6, "", 2, "x"), (4, "other", 0, "x")], key=repr)
    assert lines.dedup_lines(docs(spark)).count() == 0


def test_line_dedup_of_very_long_texts(spark):
    """A text that repeats itself over and over, and a long one that another holds within."""
    long_ = prose(3, 60_000)
    table = docs(spark, (1, "spam " * 300_000, "s"), (2, long_, "s"), (3, f"{prose(4, 30)} {long_}\n{prose(5, 30)}", "s"), (4, "spam " * 60, "s"))
    left = {r.doc_id: r for r in lines.dedup_lines(table).collect()}
    assert left[1].text.split() == ["spam"] and left[2].text == long_ and left[4].text == ""
    assert left[3].text == f"{prose(4, 30)}\n{prose(5, 30)}"


# ------------------------------------------------------------------- packing


def test_tokens_equal_the_library(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(public_tokenizers.path(packing.VOCABULARY))
    tokens = packing._tokens(None, None)
    texts = ["", " ", "a b", " lead", "trail ", "a  b", "x\n y", "x \ny", "tab\tb c", "nb\u00a0sp x", "It's they'll 12 3.5 é漢字 🙂", "a<|endoftext|>b c", "\x1c x", "\u3000 y z", prose(1, 300), "a\r\nb c", "𝟙 b"]
    for text in texts:
        assert np.frombuffer(tokens(text), "<u4").tolist() == slow.encode(text, add_special_tokens=False).ids, text


@pytest.mark.parametrize("blank", [" ", "\n", "\t", " \n"])
def test_long_runs_of_blanks(blank):
    """They are ids like any other; the faster encoder would use up its stack."""
    tokens = packing._tokens(None, None)
    for n in (packing.MOST_BLANKS - 1, 1_000_000, 2_000_000, 5_000_000)[: 4 if blank == " " else 2]:
        ids = np.frombuffer(tokens("x" + blank * n + "y"), "<u4")
        assert len(ids) > 2 and ids[0] == np.frombuffer(tokens("x"), "<u4")[0]
    at = 10_000
    short = "x" + blank * at + "y"
    assert tokens.whole(short) == tokens.slow.encode(short, add_special_tokens=False).ids


def test_packing_survives_long_runs_of_blanks(spark):
    rows = packing.pack_documents(docs(spark, (1, "x" + " " * 1_000_000 + "y", "s"), (2, "\n" * 1_000_000, "s"), (3, "a" * 1_000_000, "s"))).collect()
    assert {r.doc_id for r in rows} == {1, 2, 3} and sum(r.length for r in rows) > 1_000_000
    assert all(r.length == 1024 for r in rows if r.piece)


def slow_pack(lengths, size, most):
    """Best fit by looking at all open bins; of bins alike the one that got there last."""
    open_, out, made, filled = [], [], 0, 0  # (space, when it got there, bin)
    for n in lengths:
        fit = min((b for b in open_ if b[0] >= n), key=lambda b: (b[0], -b[1]), default=None)
        if fit:
            open_.remove(fit)
        space, _, at = fit or (size, 0, made)
        made += fit is None
        out.append((at, size - space))
        if space > n:
            open_.append((space - n, filled := filled + 1, at))
            if len(open_) > most:
                open_.remove(min(open_, key=lambda b: (b[0], -b[1])))
    return out


@pytest.mark.parametrize("bins", [1, 3, 30, 8192])
def test_packer(bins):
    draw = random.Random(bins)
    lengths = [draw.randint(1, 100) for _ in range(500)]
    placed = packing.pack(lengths, 100, bins)
    assert placed == slow_pack(lengths, 100, bins)
    fill = Counter()
    for n, (at, offset) in zip(lengths, placed):
        assert offset == fill[at]
        fill[at] += n
    assert max(fill.values()) <= 100 and sorted(fill) == list(range(len(fill)))


def test_the_bound_binds(spark):
    """With few open bins some close early, and the sequences stay near the least possible."""
    draw = random.Random(5)
    lengths = [draw.randint(1, 1024) for _ in range(20_000)]
    waves = [n for at in range(0, len(lengths), packing.WAVE_PIECES) for n in sorted(lengths[at : at + packing.WAVE_PIECES], reverse=True)]
    made = lambda bins: 1 + max(s for s, _ in packing.pack(waves, 1024, bins))
    least = -(-sum(lengths) // 1024)
    assert made(packing.OPEN_BINS) > made(len(lengths)) and made(packing.OPEN_BINS) < 1.02 * least


def test_packing_round_trip(spark):
    table = docs(spark, (1, prose(1, 3000), "s"), (2, None, "s"), (3, "", "s"), (4, "word", "s"), (4, "word", "s"), (None, "x y", "s"), *[(i, prose(i, i), "s") for i in range(5, 120)])
    rows = packing.pack_documents(clashing(table)).collect()
    tokens = packing._tokens(None, None)
    by_doc = {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
    for r in table.distinct().collect():
        ids = tokens(r.text or "") + np.asarray([2], "<u4").tobytes()
        pieces = sorted(by_doc[r.doc_id], key=lambda p: (p.piece, p.sequence_id))
        if r.doc_id == 4:
            pieces = pieces[:1]
        assert [p.piece for p in pieces] == list(range(len(pieces))) and sum(p.length for p in pieces) * 4 == len(ids)
        assert all(p.length == 1024 for p in pieces[1:]) and all(p.ids_crc32 == zlib.crc32(ids[4 * p.start : 4 * (p.start + p.length)]) for p in pieces)
    assert len(by_doc[4]) == 2
    sequences = {}
    for r in sorted(rows, key=lambda r: r.offset):
        assert sequences.get(r.sequence_id, 0) == r.offset
        sequences[r.sequence_id] = r.offset + r.length
    total = sum(sequences.values())
    assert max(sequences.values()) <= 1024 and len(sequences) <= -(-total // 1024) + 1
    assert packing.pack_documents(docs(spark)).count() == 0


# -------------------------------------------------------------------- mixing


def slow_targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    left, open_, out = 1.5 * sum(sizes.values()), set(names), {}
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if level * weight[s] > 2 * sizes[s]}
        if not over:
            out |= {s: level * weight[s] for s in open_}
            break
        out |= {s: 2 * sizes[s] for s in over}
        left -= sum(2 * sizes[s] for s in over)
        open_ -= over
    return out


@pytest.mark.parametrize("seed", range(3))
def test_mix(spark, seed):
    draw = random.Random(seed)
    rows = [(i, prose(i, draw.randint(0, 40)), draw.choice(["a", "b", "B", "é", "z", None, "hot", "hot", "hot"])) for i in range(200)]
    rows += [(400, "same words here", "a")] * 3 + [(None, "x y z", "b"), (300, None, "z"), (301, "", "only empty")]
    table = clashing(docs(spark, *rows))
    got = mixing.mix_sizes(table).collect()
    sizes = Counter()
    for _, text, source in rows:
        sizes[source] += len((text or "").split())
    want = slow_targets(dict(sizes))
    assert len(got) == len(rows) and sum(want.values()) == pytest.approx(1.5 * sum(sizes.values()))
    source_of = {i: s for i, _, s in rows}
    words = Counter()
    for r in got:
        assert r.size * 2 >= r.taken >= 0
        words[source_of[r.doc_id]] += r.taken
        assert r.target == pytest.approx(want[source_of[r.doc_id]]) and r.source_size == sizes[source_of[r.doc_id]]
    assert all(abs(words[s] - want[s]) <= 3 for s in want)
    for s in want:  # complete epochs come first
        shares = [r.taken / r.size for r in got if source_of[r.doc_id] == s and r.size]
        assert not shares or max(shares) - min(shares) <= 1
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, mixing.mix_sizes(table.repartition(7)).collect()), key=repr)


def test_mixed_documents(spark):
    rows = [(i, prose(i, 5 + i % 9), "ab"[i % 2]) for i in range(40)] + [(50, None, None)]
    table = clashing(docs(spark, *rows))
    taken = {r.doc_id: r.taken for r in mixing.mix_sizes(table).collect()}
    mixed = mixing.mix_documents(table)
    assert mixed.columns == table.columns
    words = Counter()
    for r in mixed.collect():
        assert dict((i, t) for i, t, _ in rows)[r.doc_id].startswith(r.text) and r.n_chars == len(r.text)
        words[r.doc_id] += len(r.text.split())
    assert words == Counter({i: n for i, n in taken.items() if n})
    assert mixing.mix_sizes(docs(spark)).count() == 0 and mixing.mix_documents(docs(spark)).count() == 0


def test_crowded_keys_are_split(spark):
    """A source of symbols has low weights, so long keys that crowd: ranges are split until few are sorted, with the same result."""
    draw = random.Random(8)
    rows = [(i, " ".join(w + "#" * draw.randint(2, 9) for w in prose(i, draw.randint(1, 30)).split()), "code") for i in range(1500)] + [(9000 + i, prose(i, 9), "prose") for i in range(200)]
    rows += [(20_000, "one doc again", "code")] * 40
    slim = mixing._slim(docs(spark, *rows), "mix")
    crowded = slim.where("skey = '1code'").groupBy("bucket").count().agg(F.max("count")).first()[0]
    assert crowded > 600  # the last range holds most of the source
    got = {k: sorted(map(tuple, mixing.mix_sizes(docs(spark, *rows), most=k).collect()), key=repr) for k in (5, 10**9)}
    assert got[5] == got[10**9]


def test_mixing_of_a_very_long_text(spark):
    (long_, _) = mixing.mix_sizes(docs(spark, (1, "word " * 1_000_000, "a"), (2, "b c", "b"))).orderBy("doc_id").collect()
    assert long_.size == 1_000_000 and 0 < long_.taken <= 2_000_000


def test_mixing_plan_is_native(spark):
    plan = mixing.mix_sizes(docs(spark, (1, "a b", "s")))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# ----------------------------------------------------------------------- ann


def test_neighbours_recall_and_edges(spark):
    draw = np.random.default_rng(2)
    vectors = draw.standard_normal((600, 24)).round(4)
    vectors[100:140] = vectors[5]
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(vectors)]
    bad = [(1000, None), (1020, [0.0] * 24), (1040, [float("nan")] * 24), (1060, [float("inf")] + [1.0] * 23), (1080, [None] + [1.0] * 23), (1100, [1.0]), (None, [1.0] * 24)]
    table = spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>").withColumn("score", F.lit("x"))
    got = ann.search(table, F.col("vec_id") % 20 == 0).collect()
    found = {}
    for r in got:
        found.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    hits = 0
    for q in range(0, 600, 20):
        exact = sorted(((-float((vectors[q] * vectors[i]).sum()), i) for i in range(600) if i != q))[:20]
        mine = sorted(found[q])
        assert [k for k, _, _ in mine] == list(range(1, 21))
        hits += len({i for _, i in exact} & {i for _, i, _ in mine})
        for _, i, score in mine:
            assert score == pytest.approx(float((vectors[q] * vectors[i]).sum()), rel=1e-12)
        assert [(-s, i) for _, i, s in mine] == sorted((-s, i) for _, i, s in mine)
    assert set(found) == set(range(0, 600, 20)) and hits / (20 * len(found)) > 0.95
    lengths = spark.createDataFrame([(i, [float(i % 7 + 1)] * (2 + i % 2)) for i in range(60)] + [(4, [1.0, 1.0])] * 2, "vec_id long, embedding array<double>")
    by_query = {}
    for r in ann.search(lengths, F.col("vec_id") % 20 == 0).collect():
        by_query.setdefault(r.query_id, []).append(r.vec_id)
    assert set(by_query) == {0, 20, 40} and all(len(v) == 20 and not any(i % 2 for i in v) for v in by_query.values())
    few = ann.search(table.where("vec_id < 21 and vec_id >= 18"), F.col("vec_id") % 20 == 0)
    assert few.count() == 2
    assert ann.search(table.where("false"), F.col("vec_id") % 20 == 0).count() == 0


def test_error_bounds_hold():
    draw = np.random.default_rng(4)
    rows, queries = draw.standard_normal((2000, 64)), draw.standard_normal((20, 64))
    mean, turn = rows.mean(axis=0), ann.rotation(64)
    assert np.allclose(turn @ turn.T, np.eye(64))
    for epsilon, share in ((ann.EPSILON, 0.85), (3.0, 0.995)):
        guess, error = ann.estimate(queries, *ann.encode(rows, mean, turn), mean, turn, epsilon)
        assert (np.abs(guess - queries @ rows.T) <= error).mean() > share


def test_estimates_count_bits():
    """Packed bits give what the signs themselves would, but for the rounding of the query."""
    draw = np.random.default_rng(6)
    rows, queries = draw.standard_normal((50, 70)), draw.standard_normal((5, 70))
    mean, turn = rows.mean(axis=0), ann.rotation(70)
    codes, numbers = ann.encode(rows, mean, turn)
    assert codes.shape == (50, 2) and codes.dtype == np.uint64
    rest = rows - mean
    turned = rest / np.linalg.norm(rest, axis=1, keepdims=True) @ turn
    signs = np.where(turned > 0, 1, -1) / np.sqrt(70)
    want = (queries - mean) @ turn @ signs.T / (turned * signs).sum(axis=1) * np.linalg.norm(rest, axis=1) + rows @ mean + ((queries - mean) @ mean)[:, None]
    guess, error = ann.estimate(queries, codes, numbers, mean, turn, 0.0)
    assert (np.abs(guess - want) <= error + 1e-4).all() and error.max() < 0.02 * 70


def test_the_share_reranked_falls():
    """Among more rows the 20th best is better, so that fewer rows reach it."""
    draw = np.random.default_rng(7)
    rows = draw.standard_normal((8000, 64))
    rows /= np.linalg.norm(rows, axis=1, keepdims=True)
    turn, shares = ann.rotation(64), []
    for n in (500, 2000, 8000):
        mean = rows[:n].mean(axis=0)
        found, reranked = ann.search_block(np.arange(40), rows[:40], np.arange(n), rows[:n], *ann.encode(rows[:n], mean, turn), mean, turn)
        shares.append(reranked / n / 40)
        exact = rows[:40] @ rows[:n].T
        exact[np.arange(40), np.arange(40)] = -np.inf
        hits = sum(len(set(np.argsort(-exact[i])[:20]) & set(near)) for i, near, _ in found)
        assert hits / 800 > 0.97
    assert shares[0] > shares[1] > shares[2] and shares[2] < 0.3


def test_neighbours_in_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(ann, "ROWS", 50 * 16)
    monkeypatch.setattr(ann, "QUERIES", 4 * 16)
    vectors = np.random.default_rng(8).standard_normal((300, 16))
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    got = {(r.query_id, r["rank"]): r.vec_id for r in ann.search(table, F.col("vec_id") % 20 == 0).collect()}
    want = {(q, k + 1): int(i) for q in range(0, 300, 20) for k, i in enumerate([i for i in np.argsort(-(vectors @ vectors[q])) if i != q][:20])}
    assert sum(got[k] == want[k] for k in want) / len(want) > 0.93 and len(got) == len(want)


# --------------------------------------------------------------- classifier


def test_classifier_held_out(spark):
    rows, labels = [], []
    for i in range(400):
        good = i % 3 > 0
        text = prose(i, 60)
        rows.append((i, text if good else " ".join(w + "###" for w in text.split()) if i % 2 else "spam " * 60, "s"))
        labels.append((i, int(good), 0))
    rows += [(1000, None, "s"), (1001, "", "s"), (1002, " \n", "s"), (None, prose(5, 60), None), (3, rows[3][1], "s")]
    labels += [(0, 0, 0), (2000, 1, 0), (None, 1, 0), (5, 7, 0)]
    table = docs(spark, *rows)
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = classifier.train(table, known)
    scored = classifier.score_documents(clashing(table), model)
    assert scored.columns == [*clashing(table).columns, "score"] and scored.count() == len(rows)
    got = classifier.score_documents(table, model).withColumn("out", classifier.held_out()).collect()
    assert all(0 <= r.score <= 1 for r in got)
    out = [r for r in got if r.out and r.doc_id < 400]
    assert all(r.out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got if r.doc_id is not None) and len(out) > 50
    assert sum((r.score >= 0.7) == (r.doc_id % 3 > 0) for r in out) / len(out) > 0.95
    assert len({r.score for r in got if r.doc_id in (1000, 1001, 1002)}) == 1
    assert classifier.score_documents(docs(spark), model).count() == 0
    blank = classifier.train(table, known.where("false"))
    assert {r.score for r in classifier.score_documents(table, blank).collect()} == {0.5}


def test_held_out_labels_do_not_matter(spark):
    table = docs(spark, *[(i, prose(i, 30), "s") for i in range(60)])
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")
    turned = labels.withColumn("quality", F.when(classifier.held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = classifier.train(table, labels), classifier.train(table, turned)
    assert np.array_equal(a.vectors, b.vectors) and np.array_equal(a.labels, b.labels)
    assert len(classifier.train(table, labels, sample=10).labels) == 10


def slow_terms(text):
    """A text's terms, counted word by word."""
    words = text.split()
    out = [0.0] * classifier.TERMS
    if not words:
        return out
    n, kinds = len(words), len(set(words))
    for w in words:
        upper = "" if w == w.lower() else "U" if w == w.upper() and len(w) > 2 else "T" if w[0] != w[0].lower() else "M"
        shape = re.sub(r"\d+", "9", re.sub(r"[^\W\d_]+", "a", w))
        out[zlib.crc32(w.lower().encode()) % 512] += 1 / n
        out[512 + zlib.crc32((upper + shape).encode()) % 512] += 1 / n
    out[:1024] = [x**0.5 * (0.25 if k < 512 else 1) for k, x in enumerate(out[:1024])]
    for k, lag in enumerate((1, 2, 3, 4, 5)):
        share = sum(a == b for a, b in zip(words, words[lag:])) / n
        out[1024 + 2 * k : 1026 + 2 * k] = share**0.5, (1 - share) ** 0.5 / 5
    out[-2:] = (n - kinds) / n / (1 + np.log(n)), 1 / (1 + np.log(n)) / 4
    return out


def test_terms_against_brute_force():
    texts = ["", " \n", "a", "A b B12 x_9 ###! iPhone NASA Ab", "spam " * 50, prose(3, 200), "long" * 30 + "-" * 20, "É é 漢字 12.5%", "a-b.c/d_e:f;g,h!i?j 1-2.3/4"]
    for text in texts:
        assert np.allclose(classifier.term_vector(text), slow_terms(text), atol=1e-6), text
    assert classifier.term_vector("word other " * 1_000_000).any()


def test_frequencies_and_latent_vectors_against_brute_force():
    """The truncated SVD keeps the cosines of an exact one, where the spectrum falls."""
    draw = np.random.default_rng(9)
    terms = np.abs(draw.standard_normal((120, 6)) @ np.diag([90, 60, 40, 2, 1, 1]) @ draw.standard_normal((6, classifier.TERMS))).astype(np.float32)
    terms[:, :20] = 0
    idf = [np.log(121 / (1 + sum(row[k] > 0 for row in terms))) + 1 for k in range(classifier.TERMS)]
    assert np.allclose(classifier.inverse_frequencies(terms), idf)
    model = classifier.fit(terms, np.ones(120), 3)
    weighted = terms * np.array(idf)
    left, values, _ = np.linalg.svd(weighted, full_matrices=False)
    exact = left[:, :3] * values[:3]
    exact /= np.linalg.norm(exact, axis=1, keepdims=True)
    assert np.abs(model.vectors @ model.vectors.T - exact @ exact.T).max() < 5e-3


def test_ties_at_the_last_place():
    """Neighbours alike share the last places, in whatever order the sample comes."""
    vectors = np.array([[1.0, 0], [0, 1], [0, 1], [0, 1], [0, 1]])
    labels = np.array([1.0, 1, 0, 0, 0])
    query = np.zeros((1, classifier.TERMS), np.float32)
    query[0, :2] = 0.6, 0.8
    projection = np.eye(classifier.TERMS, 2)
    scores = set()
    for order in ([0, 1, 2, 3, 4], [4, 3, 2, 1, 0], [2, 1, 0, 4, 3]):
        scores.add(float(classifier.Model(projection, vectors[order], labels[order], 0.5).score(query, 3)[0]))
    near, far = 0.8**classifier.POWER + 1e-9, 0.6**classifier.POWER + 1e-9
    assert scores == {round(0.25, 9)} and near > far


def test_a_sample_document_that_is_everywhere(spark):
    """Rows that repeat a labelled doc_id count once, so none of the sample is cut off."""
    rows = [(1, prose(1, 30), "s")] * 60 + [(i, prose(i, 30), "s") for i in range(2, 20)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 20)], "doc_id long, quality int")
    model = classifier.train(docs(spark, *rows), labels)
    assert len(model.labels) == sum(zlib.crc32(str(i).encode()) % 4 != 2 for i in range(1, 20))


def test_votes_against_brute_force():
    draw = np.random.default_rng(3)
    terms = np.abs(draw.standard_normal((300, classifier.TERMS))).astype(np.float32)
    model = classifier.fit(terms[:200], (draw.random(200) > 0.4).astype(float))
    scores = model.score(terms, 5)
    for i in (0, 150, 250):
        cosines = model.vectors @ model.embed(terms[i : i + 1])[0]
        best = np.argsort(-cosines)[:5]
        weights = np.maximum(cosines[best].astype(float), 0) ** classifier.POWER + 1e-9
        assert scores[i] == pytest.approx((weights * model.labels[best]).sum() / weights.sum(), abs=1e-6)


# --------------------------------------------------------------------- rules


def slow_rules(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    grams = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {j for i in range(len(words) - 2) if grams[tuple(words[i : i + 3])] > 1 for j in range(i, i + 3)}
    some = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(some) - len(set(some)), len(covered)


def test_rules_against_brute_force(spark):
    draw = random.Random(9)
    texts = [None, "", " \n\t", "a", "a b", "a b c", "a b c a b c", "a a a a", "x\u00a0y z", "💡 é #|<>", "l\nl\n \n \nm\nl", "a\rb\x0bc"]
    texts += [" ".join(draw.choices(["a", "b", "c#", "the", "x\n"], k=draw.randint(1, 120))) for _ in range(40)] + ["the " + prose(1, 20_000), "spam and eggs " * 3000]
    got = {r.doc_id: r for r in rules.apply_rules(clashing(docs(spark, *[(i, t, "s") for i, t in enumerate(texts)]))).collect()}
    for i, text in enumerate(texts):
        r, want = got[i], slow_rules(text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want, repr(text)
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0]) and r.kept == (not r.base_failed and not r.failed)
    assert rules.apply_rules(docs(spark)).count() == 0
    plan = rules.apply_rules(docs(spark, (1, "a", "s")))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan


def test_each_rule_can_fail(spark):
    base = " ".join(f"{w} the" for w in prose(1, 60).split())
    cases = {None: base, "symbols": " ".join(w + "#" for w in base.split()), "few_stop_words": prose(2, 100).replace("e", "x").replace("a", "y"), "short_words": " ".join(f"{chr(97 + i % 26)} {chr(97 + i // 26 % 26)} a" for i in range(60)), "long_words": " ".join(f"{w * 9} the" for w in prose(1, 60).split()), "repeated_lines": base + "\nof" * 5}
    for rule, text in cases.items():
        failed = rules.apply_rules(docs(spark, (1, text, "s"))).first().failed
        assert (rule in failed) if rule else failed == [], (rule, failed)


# ---------------------------------------------------------------------- urls


def slow_judge(url, table):
    host, path = urls.split_url(url)
    fits = [(h.count("."), len(h), len(p), h + p, v) for h, p, v in table if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (max(fits)[3], max(fits)[4]) if fits else (None, urls.DEFAULT)


def test_urls(spark):
    cases = {
        "http://a.example.org/es/x": ("a.example.org", "/es/x", "example.org/es/", "block"),
        "http://EXAMPLE.org/es": ("example.org", "/es", "org/", "allow"),
        "x://example.org/en/12?q#f": ("example.org", "/en/12", "example.org/en/1", "block"),
        "http://example.org?/en/1": ("example.org", "", None, "allow"),
        "http://notexample.org/en/1": ("notexample.org", "/en/1", "org/", "allow"),
        "http://a.com/de/": ("a.com", "/de/", "com/de/", "block"),
        "http://a.com:80/de/": ("a.com:80", "/de/", None, "allow"),
        "http://a.com/fr/#x/y": ("a.com", "/fr/", "com/fr/", "allow"),
        "a.com/de/": ("", "", None, "allow"),
        "http://": ("", "", None, "allow"),
        "http:///de/": ("", "/de/", None, "allow"),
        "u:p://x://é.ÉE.org/É?": ("x:", "//é.ÉE.org/É", None, "allow"),
        "http://.org/": (".org", "/", "org/", "allow"),
        None: ("", "", None, "allow"),
        "": ("", "", None, "allow"),
    }
    table = spark.createDataFrame([(i, u) for i, u in enumerate(cases)], "page_id long, url string").withColumns({c: F.lit(1) for c in ("host", "rule", "_url")})
    got = {r.page_id: tuple(r)[1:] for r in urls.judge_urls(table).collect()}
    assert got == {i: v for i, v in enumerate(cases.values())}
    assert urls.judge_urls(table.where("false")).count() == 0


def test_trie_against_brute_force():
    draw = random.Random(4)
    hosts = ["org", "a.org", "b.a.org", "com", "a.com", "x.b.a.org"]
    paths = ["/", "/e", "/en", "/en/", "/en/1", "/en/1/", "", "/fr/x"]
    for _ in range(200):
        table = list({(draw.choice(hosts), draw.choice(paths)): draw.choice(["allow", "block"]) for _ in range(8)}.items())
        table = [(h, p, v) for (h, p), v in table]
        trie = urls.Trie(table)
        for _ in range(20):
            url = "http://" + draw.choice(["", "w.", "b."]) + draw.choice(hosts) + draw.choice([*paths, "/en/12", "/english", "/fr/xyz/"])
            assert trie.judge(*urls.split_url(url)) == slow_judge(url, table), (url, table)


# ------------------------------------------------------------------ licences


def test_licences(spark):
    mit = licences.text_of("MIT")
    variants = [
        mit, mit.upper().replace('"', "'"), "Copyright 2020 Someone, Ltd.\n(c) 1999 x\n" + mit.replace("\n", "\r\n"), mit.replace("noninfringement".upper(), "NON-INFRINGEMENT").replace("sublicense", "sublicence"),
        mit + " and more", "prose\nReleased under the MIT licence!\nmore", "All rights   reserved", None, "", "...\n...", "Copyright 2020", "Copyright 2020 X. All rights reserved.",
    ]
    table = clashing(docs(spark, *[(i, t, "s") for i, t in enumerate(variants)], (6, "All rights reserved", "s"), (20, ("prose " * 10 + "\n") * 100_000 + "Licensed under CC BY 4.0.", "s")))
    got = {(r.doc_id, r.license, r.scope): r.hits for r in licences.scan_licenses(table).collect()}
    want = {(i, "MIT", "document"): 1 for i in range(4)} | {(5, "MIT", "line"): 1, (6, "all-rights-reserved", "document"): 2, (6, "all-rights-reserved", "line"): 2}
    assert got == want | {(11, "all-rights-reserved", s): 1 for s in ("document", "line")} | {(20, "CC-BY-4.0", "line"): 1}
    assert licences.scan_licenses(docs(spark)).count() == 0


def test_whole_licence_texts(spark):
    """Each known text, unwrapped and wrapped anew, under its titles, with curly quotes, and without its appendix."""
    # A copyright line ends with its line, so it isn't joined with the next.
    wrap = lambda text, n: "\n\n".join(p if "Copyright (C)" in p else textwrap.fill(" ".join(p.split()), n) for p in text.split("\n\n"))
    curly = lambda text: re.sub('"([^"]*)"', "\u201c\\1\u201d", text).replace("'", "\u2019").replace("- ", "\u2013 ")
    cases = {}
    for name, titles in licences.TITLES.items():
        text = licences.text_of(name)
        for k, shape in enumerate((text, wrap(text, 60), wrap(text, 10_000), curly(text))):
            cases[len(cases)] = (name, shape)
        for title in titles:
            cases[len(cases)] = (name, f"{title}\n\nCopyright (c) 2021-2023, Jane Doe <jane@example.org>\nAll rights reserved.\n\n{text}")
            cases[len(cases)] = (name, f"# {title}\n\nCopyright \u00a9 2021 The Project Authors\n\n{wrap(text, 72)}")
        if licences.END in text:
            cases[len(cases)] = (name, text[: text.index(licences.END)])
    cases[len(cases)] = (None, licences.text_of("ISC").replace("without fee", "for a fee"))
    got = licences.scan_licenses(docs(spark, *[(i, t, "s") for i, (_, t) in cases.items()])).where("scope = 'document'").collect()
    assert {r.doc_id: r.license for r in got} == {i: n for i, (n, _) in cases.items() if n}


def test_copyright_lines_of_many_shapes(spark):
    """What stands above a licence in practice doesn't hide it."""
    mit = licences.text_of("MIT")
    heads = [
        "Copyright Jane Doe", "# Copyright Jane Doe and others", "Copyright (c) 2019 A\nAll rights reserved.\nCopyright (c) 2020 B. All rights reserved.", "Portions Copyright (c) 2020 X", "Portions Copyright Example Corp.",
        "Copyright (c) 2020 Jane Doe,\nJohn Roe and\nthe Example Project", "SPDX-License-Identifier: MIT\n\nCopyright (c) 2020 Jane", "Expat License", "The MIT License\n\nCopyright \u00a9 2001 - 2020, Jane &\nJohn",
    ]
    rows = [(i, f"{head}\n\n{mit}", "s") for i, head in enumerate(heads)]
    rows += [(100, "SPDX-License-Identifier: GPL-2.0-or-later\n" + licences.text_of("GPL-2.0"), "s"), (101, "Copyright Holder means anyone.\n" + mit, "s"), (102, "x\nSPDX-License-Identifier: GPL-3.0-or-later", "s"), (103, "x\n// SPDX-License-Identifier: AGPL-3.0-only", "s")]
    got = licences.scan_licenses(docs(spark, *rows)).collect()
    whole = {r.doc_id: r.license for r in got if r.scope == "document"}
    assert whole == {i: "MIT" for i in range(len(heads))} | {100: "GPL-2.0"}
    assert {r.doc_id: r.license for r in got if r.scope == "line" and r.doc_id > 101} == {102: "GPL-3.0-or-later", 103: "AGPL-3.0"}


def test_two_licences_with_one_text(spark):
    found = licences.scan_licenses(docs(spark, (1, "the same words", "s")), [("b", "The same: words."), ("a", "the SAME words")])
    assert [(r.license, r.scope, r.hits) for r in found.orderBy("scope").collect()] == [("a", "document", 1), ("a", "line", 1)]


# ---------------------------------------------------------------------- warc


def pages(spark, *rows):
    return spark.createDataFrame(list(rows), "page_id long, url string, html string")


def test_warc_round_trip(spark):
    long_ = "WARC/1.1\r\n\r\nContent-Length: 5\r\n\r\n" + "é" * 60
    table = pages(
        spark, (5, "http://a/\r\nX: y", long_), (3, None, long_), (9, "http://c", long_), (1, "u", "short"), (2, "u", "short"), (7, "u", None), (8, "u", ""), (10, "u", "x" * 100), (11, "u", "x" * 100), (11, "u", "x" * 100), (12, "u", "y" * 99), (13, "u", "y" * 99),
    ).withColumn("block", F.lit(1))
    path = shared_folder(spark, "warc")
    warc.write_archives(table, path)
    records = warc.read_archives(spark, path, with_payload=True)
    resolved = sorted(warc.resolve_revisits(records.drop("payload")).collect(), key=lambda r: r.page_id)
    got = [(r.page_id, r.record_type, r.refers_to, r.payload_bytes) for r in resolved]
    n = len(long_.encode())
    assert got == [
        (1, "response", None, 5), (2, "response", None, 5), (3, "response", None, n), (5, "revisit", 3, n), (7, "response", None, 0), (8, "response", None, 0), (9, "revisit", 3, n),
        (10, "response", None, 100), (11, "revisit", 10, 100), (11, "revisit", 10, 100), (12, "response", None, 99), (13, "response", None, 99),
    ]
    payloads = {r.page_id: r.payload for r in records.collect() if r.record_type == "response"}
    assert payloads[3].decode() == long_ and payloads[7] == b""
    assert {r.page_id: r.url for r in records.collect()}[5] == "http://a/%0D%0AX: y"
    again = shared_folder(spark, "warc")
    warc.deduplicate_archives(spark, path, again)
    # As many records as before, of the same kinds, and revisits still know their originals.
    twice = warc.resolve_revisits(warc.read_archives(spark, again)).collect()
    assert sorted((r.page_id, r.record_type, r.refers_to, r.payload_bytes) for r in twice) == sorted(got)
    for folder in (path, again):
        names = [r.record for r in warc.read_archives(spark, folder).collect()]
        assert len(set(names)) == len(names) == 12


def raw_archive(*records):
    out = b""
    for fields, block in records:
        lines = "".join(f"{k}: {v}\r\n" for k, v in {**fields, "Content-Length": len(block)}.items())
        out += gzip.compress(f"WARC/1.0\r\n{lines}\r\n".encode() + block + b"\r\n\r\n")
    return out


def test_archives_from_elsewhere(spark, tmp_path):
    """Other ids, digests of another kind, bytes that are no text, headers of their own, revisits with and without originals."""
    page, other = b"\xff\xfe\x00" * 60, b"y" * 150
    http = b"HTTP/1.1 404 Not Found\r\nX-Own: 1\r\n\r\n"
    sha = lambda b: "sha256:" + hashlib.sha256(b).hexdigest()
    fields = lambda kind, n, digest, **more: {"WARC-Type": kind, "WARC-Record-ID": f"<urn:uuid:{n}>", "WARC-Date": f"2020-01-0{n}T00:00:00Z", "WARC-Target-URI": f"http://h/{n}", "WARC-Payload-Digest": digest} | more
    records = [
        ({"WARC-Type": "warcinfo"}, b"software: x"),
        (fields("response", 1, sha(page)), http + page), (fields("response", 2, "sha1:ABC"), http + page), (fields("response", 3, sha(other)), http + other),
        (fields("revisit", 4, sha(page), **{"WARC-Refers-To": "<urn:uuid:2>"}), http), (fields("revisit", 5, sha(b"gone" * 50), **{"WARC-Refers-To": "<urn:uuid:lost>"}), http),
        (fields("revisit", 6, sha(other)), http), (fields("response", 7, sha(b"s")), http + b"s"), (fields("response", 8, sha(b"s")), http + b"s"),
    ]
    (tmp_path / "raw.warc.gz").write_bytes(raw_archive(*records))
    clean = shared_folder(spark, "clean")
    warc.deduplicate_archives(spark, str(tmp_path), clean)
    got = {r.record[10:-1]: r for r in warc.read_archives(spark, clean, with_payload=True).collect()}
    assert {k: (r.record_type, r.refers_to_record) for k, r in got.items()} == {
        "1": ("response", None), "2": ("revisit", "<urn:uuid:1>"), "3": ("response", None), "4": ("revisit", "<urn:uuid:1>"), "5": ("revisit", "<urn:uuid:lost>"),
        "6": ("revisit", "<urn:uuid:3>"), "7": ("response", None), "8": ("response", None),
    }
    assert bytes(got["1"].payload) == page and all(bytes(r.http) == http and r.date == f"2020-01-0{k}T00:00:00Z" for k, r in got.items())
    assert {r.page_id for r in got.values()} == {None}


def test_archives_are_bounded(spark):
    table = pages(spark, *[(i, f"u{i}", "x" * (1000 + i)) for i in range(60)], (99, "big", "long " * 400_000))
    path = shared_folder(spark, "warc")
    warc.write_records(warc.page_records(table.coalesce(1)), path, records_per_archive=7, date="2001-02-03T04:05:06Z")
    found = warc.read_archives(spark, path, with_payload=True)
    assert found.inputFiles().__len__() == 9 and found.count() == 61 and {r.date for r in found.select("date").collect()} == {"2001-02-03T04:05:06Z"}
    assert len(found.where("page_id = 99").first().payload) == 2_000_000
    assert warc.records_per_archive(warc.headers(warc.page_records(table)), 100_000) == 2


def test_raw_archives_are_deduplicated(spark):
    table = pages(spark, *[(i, f"u{i}", "same " * 40) for i in range(6)], (9, "v", "z"))
    raw, clean = shared_folder(spark, "raw"), shared_folder(spark, "clean")
    warc.write_records(warc.page_records(table), raw)
    assert warc.read_archives(spark, raw).where("record_type = 'response'").count() == 7
    warc.deduplicate_archives(spark, raw, clean)
    kinds = Counter((r.record_type, r.refers_to) for r in warc.read_archives(spark, clean).collect())
    assert kinds == {("response", None): 2, ("revisit", 0): 5}


def test_warc_parser():
    record = b"WARC/1.0\r\nWARC-Type: response\r\nContent-Length: 4\r\n\r\nab\r\n\r\n\r\n"
    for raw in (record * 2, gzip.compress(record) + gzip.compress(record)):
        assert [b for _, b in warc.parse_archive(io.BytesIO(raw))] == [b"ab\r\n"] * 2
    with pytest.raises(EOFError):
        list(warc.parse_archive(io.BytesIO(record[:-8])))
    with pytest.raises(ValueError):
        list(warc.parse_archive(io.BytesIO(b"nonsense\r\n")))
    assert list(warc.parse_archive(io.BytesIO(b""))) == []


def test_warc_edges(spark):
    empty = pages(spark)
    path = shared_folder(spark, "warc")
    warc.write_archives(empty, path)
    assert warc.read_archives(spark, path).count() == 0
    table = pages(spark, (None, "u", "n" * 200), (4, "u", "n" * 200), (None, "u", "k" * 200), (None, None, None))
    path = shared_folder(spark, "warc")
    warc.write_archives(table, path)
    got = Counter((r.page_id, r.record_type, r.refers_to, r.payload_bytes) for r in warc.resolve_revisits(warc.read_archives(spark, path)).collect())
    assert got == {(4, "response", None, 200): 1, (None, "revisit", 4, 200): 1, (None, "response", None, 200): 1, (None, "response", None, 0): 1}


