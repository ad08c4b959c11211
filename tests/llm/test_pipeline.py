"""The pipeline against a brute-force version, stage by stage and as a whole."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.test_operators import alike_groups, prose, slow_dedup, slow_fingerprint, slow_groups, slow_targets
from victual.llm import classifier, packing

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Clean, junk, copied, nearly copied and partly copied documents."""
    draw, rows, labels = random.Random(11), [], []
    passage = prose(500, 60)
    for i in range(160):
        text = "\n".join(prose(1000 * i + k, draw.randint(8, 30)) for k in range(draw.randint(3, 9)))
        good = i % 5 > 0
        if not good:
            text = " ".join(w + "$$$" for w in text.split(" ")) if i % 2 else "junk " * 80
        elif i % 7 == 1:
            text = f"{text}\n{passage}"
        elif i % 11 == 3 and rows:
            text = next(t for _, t, *_ in reversed(rows) if "$" not in t and not t.startswith("junk"))
        rows.append((i, text, "en", draw.choice(["a", "a", "b", None]), len(text)))
        labels.append((i, int(good), 0))
    base = prose(88, 48).split()  # near copies that SimHash doesn't link: two words at the ends of each differ
    near = [" ".join(base[:a] + [prose(600 + a, 1)] + base[a + 1 : -b] + [prose(700 + a, 1)] + base[len(base) - b + 1 :]) for a, b in ((2, 1), (1, 2), (1, 1), (2, 2))]
    rows += [(401 + k, text, "en", "a", len(text)) for k, text in enumerate([" ".join(base), *near])]
    base = prose(77, 40)  # too short for line dedup: left to the fingerprints
    rows += [(200 + k, base if k % 2 else base.upper(), "en", "b", len(base)) for k in range(4)] + [(300, "", "en", "a", 0), (301, None, None, None, None)]
    path = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


@pytest.fixture(scope="module")
def stages(spark, folder, tmp_path_factory):
    """What each stage is given and what it gives, as the pipeline's runner writes and rereads them."""
    docs, out = spark.read.parquet(f"{folder}/documents.parquet"), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path_factory.mktemp("stage") / str(k))
        stage(spark, docs, folder).write.parquet(path)
        after = spark.read.parquet(path)
        out.append((docs.collect(), after.collect(), after.columns))
        docs = after
    return out


def test_stages_return_documents(stages):
    assert [columns for _, _, columns in stages[:-1]] == [COLUMNS] * 4
    assert all(after for _, after, _ in stages)


def test_quality(spark, folder, stages):
    before, after, _ = stages[0]
    model = classifier.train(spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet"))
    scores = model.score(np.array([classifier.term_vector(r.text or "") for r in before]))
    assert {r.doc_id for r in after} == {r.doc_id for r, s in zip(before, scores) if s >= 0.7}
    kept = {r.doc_id for r in after}
    assert sum((i in kept) == (i % 5 > 0) for i in range(160)) > 155


def test_lines(stages):
    before, after, _ = stages[1]
    want = slow_dedup([(r.doc_id, r.text) for r in before if r.text is not None], 50)
    assert {r.doc_id: r.text for r in after if r.text is not None} == want and len(before) == len(after)
    assert all(r.n_chars == len(r.text) for r in after if r.text is not None)
    assert sum(prose(500, 60) in (r.text or "") for r in after) == 1


def test_near_duplicates(stages):
    before, after, _ = stages[2]
    groups = slow_groups({r.doc_id: slow_fingerprint(r.text) for r in before})
    first = {r.doc_id: r.text for r in before if r.doc_id in set(groups.values())}
    near = alike_groups({i: t for i, t in first.items() if (t or "").split()})
    kept = {i for i in first if near.get(i, i) == i}
    assert sorted(r.doc_id for r in after) == sorted(kept) and len(kept) < len(first) < len(groups)
    assert not kept & {402, 403, 404, 405}


def test_mix_meets_targets(stages):
    before, after, _ = stages[3]
    sizes, words = Counter(), Counter()
    for r in before:
        sizes[r.source] += len((r.text or "").split())
    for r in after:
        words[r.source] += len(r.text.split())
    assert all(abs(words[s] - t) <= 1 for s, t in slow_targets(dict(sizes)).items())
    texts = {r.doc_id: " ".join((r.text or "").split()) for r in before}
    assert all(texts[r.doc_id].startswith(" ".join(r.text.split())) for r in after)


def test_packing_holds_every_token(stages):
    before, after, _ = stages[4]
    tokens = packing._tokens(None, None)
    want = Counter()
    for r in before:
        want[r.doc_id] += len(tokens(r.text)) // 4 + 1
    got, fill = Counter(), {}
    for r in sorted(after, key=lambda r: r.offset):
        got[r.doc_id] += r.length
        assert fill.get(r.sequence_id, 0) == r.offset
        fill[r.sequence_id] = r.offset + r.length
    assert got == want and max(fill.values()) <= 1024


def test_run_equals_its_stages(spark, folder, stages):
    digest = lambda rows: sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows)
    assert digest(corpus_pipeline.run(spark, folder).collect()) == digest(stages[-1][1])


def test_extra_columns_of_any_name(spark, folder, tmp_path):
    """Those that operators use inside, and names that expressions must quote."""
    names = ("score", "lines_deleted", "taken", "size", "key", "skey", "fp", "n", "row", "label", "_text", "_h", "_kept", "_gone", "_c0", "a.b", "a b", "x`y")
    table = spark.read.parquet(f"{folder}/documents.parquet")
    table.withColumns({n: F.lit("x") for n in names}).write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{folder}/labels.parquet").write.parquet(str(tmp_path / "labels.parquet"))
    places = lambda rows: sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows)
    assert places(corpus_pipeline.run(spark, str(tmp_path)).collect()) == places(corpus_pipeline.run(spark, folder).collect())
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns and all(r[-1] == "x" for r in out.collect())


def test_empty_corpus(spark, folder, tmp_path):
    for name in ("documents", "labels"):
        spark.read.parquet(f"{folder}/{name}.parquet").where(F.lit(False)).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
