"""Toxicity: held-out accuracy and odd rows; the pipeline stage by stage."""

import random
import zlib
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from flowwatch.llm import toxicity

SF01 = "/root/testdata/sf0.01"
RUDE = ["blorp", "zanko", "idiot", "vexil", "moron"]


def made(n, seed, toxic_share=0.2):
    r = random.Random(seed)
    plain = ["".join(r.choices("abcdefghijkl", k=r.randint(2, 7))) for _ in range(400)]
    docs, labels = [], []
    for i in range(n):
        words = r.choices(plain, k=r.randint(5, 200))
        toxic = r.random() < toxic_share
        if toxic:
            for _ in range(r.randint(2, 5)):
                words.insert(r.randrange(len(words)), r.choice(RUDE))
        docs.append((i, " ".join(words)))
        labels.append((i, int(toxic) if r.random() > 0.03 else int(not toxic)))
    return docs, labels


def test_held_out_accuracy(spark):
    docs, labels = made(1500, 1)
    truth = dict(labels)
    got = toxicity.score_documents(spark.createDataFrame(docs, "doc_id long, text string"),
                                   spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
    assert len(got) == len(docs)
    for g in got:
        assert g.held_out == (zlib.crc32(str(g.doc_id).encode()) % 5 == 0) and 0 <= g.score <= 1
        assert g.predicted == int(g.score >= 0.5)
    held = [g for g in got if g.held_out]
    assert np.mean([g.predicted == truth[g.doc_id] for g in held]) >= 0.93        # 3 % of the labels are wrong
    # texts decide, not wrong labels
    rude = {i for i, t in docs if set(t.split()) & set(RUDE)}
    assert np.mean([g.predicted == (g.doc_id in rude) for g in got]) >= 0.97


def test_held_out_labels_do_not_matter(spark):
    docs, labels = made(600, 2)
    flipped = [(i, 1 - y if zlib.crc32(str(i).encode()) % 5 == 0 else y) for i, y in labels]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    a, b = (sorted(map(tuple, toxicity.score_documents(d, spark.createDataFrame(x, "doc_id long, toxic int")).collect()))
            for x in (labels, flipped))
    assert a == b


def test_scores_do_not_depend_on_the_order_of_rows(spark):
    docs, labels = made(600, 4)
    got = []
    for k in (1, 3, 7):
        d = spark.createDataFrame(docs[k:] + docs[:k], "doc_id long, text string").repartition(k)
        got.append(sorted(map(tuple, toxicity.score_documents(d, spark.createDataFrame(labels, "doc_id long, toxic int").repartition(k)).collect())))
    assert got[0] == got[1] == got[2]


def test_bound_of_labelled_rows_holds_for_repeated_ids(spark):
    docs = spark.createDataFrame([(i % 30, f"text {i}") for i in range(900)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(30)] * 3, "doc_id long, toxic int")
    assert toxicity.labelled_sample(docs, labels, 5).count() == 5


def test_label_model_finds_bad_and_doubled_voters():
    r = np.random.default_rng(3)
    y = r.random(4000) < 0.3
    good = np.where(r.random((4000, 4)) < 0.85, np.where(y, 1, -1)[:, None], np.where(y, -1, 1)[:, None])
    bad = np.where(r.random((4000, 1)) < 0.5, 1, -1)
    votes = np.column_stack([good, bad, bad, bad, bad]).astype(np.int8)
    m = toxicity.LabelModel()
    post = m.fit(votes, np.clip((good.mean(axis=1) + 1) / 2, 0.05, 0.95))
    assert np.mean((post > 0.5) == y) > 0.9
    assert min(m.accuracy[:4]) > 0.78 and max(m.accuracy[4:]) < 0.6
    # the copies hang together in the tree
    assert sum(m.parent[j] >= 4 for j in range(5, 8)) >= 3 or sum(m.parent[j] >= 4 for j in range(4, 8)) >= 3


def test_odd_rows(spark, odd_docs, odd_rows, empty_docs):
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (4, None, 0), (None, 1, 0), (5, 1, 0), (5, 0, 0), (999, 1, 1)],
                                   "doc_id long, toxic int, quality int")
    got = toxicity.score_documents(odd_docs, labels).collect()
    assert len(got) == len(odd_rows) and all(0 <= g.score <= 1 for g in got)
    assert [g.held_out for g in got if g.doc_id is None] == [False, False]
    assert toxicity.score_documents(empty_docs, labels).count() == 0
    assert toxicity.score_documents(odd_docs, labels.limit(0)).count() == len(odd_rows)
    kept = toxicity.keep_clean(odd_docs, labels.limit(0))
    assert kept.columns == odd_docs.columns and kept.count() == len(odd_rows)


def test_plain_model_without_labels(spark):
    docs = spark.createDataFrame([(1, "you are an idiot and a moron, idiot"), (2, "a fine day"), (3, None)], "doc_id long, text string")
    got = {r.doc_id: r.predicted for r in toxicity.score_documents(docs, spark.createDataFrame([], "doc_id long, toxic int")).collect()}
    assert got == {1: 1, 2: 0, 3: 0}


# ---- pipeline

@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """What each stage of the pipeline was given and gave, at the small scale."""
    folder = tmp_path_factory.mktemp("stages")
    docs = spark.read.parquet(f"{SF01}/documents.parquet")
    seen = [docs]
    for name, f in corpus_pipeline.STAGES:
        f(spark, seen[-1], SF01).write.parquet(str(folder / name))
        seen.append(spark.read.parquet(str(folder / name)))
    return seen


def test_stage_columns(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "simhash", "mixing", "sentencepiece"]
    for d in stages[1:-1]:
        assert d.columns == stages[0].columns


def test_stages_do_their_work(spark, stages):
    from .test_text_operators import components_brute, line_brute, mix_brute, simhash_brute
    docs, clean, lined, single, mixed, ids = ([tuple(r) for r in d.collect()] for d in stages)
    clean_ids = {r[0] for r in clean}
    assert set(clean) <= set(docs) and len(clean) > 0.85 * len(docs)
    # lines
    want = {d: h for d, _, _, h in line_brute([r[:2] for r in clean])}
    import hashlib
    assert {r[0]: hashlib.sha256(r[1].encode()).hexdigest() for r in lined} == want
    assert all(r[4] == len(r[1]) for r in lined)
    # near-duplicates
    fps = [(r[0], simhash_brute(r[1])) for r in lined]
    assert {r[0] for r in single} == set(components_brute(fps).values()) and len(single) == len({r[0] for r in single})
    # mixture
    by_id = {r[0]: r for r in single}
    size, target = mix_brute([(r[3], len(r[1].split())) for r in single])
    copies, words = Counter(r[0] for r in mixed), Counter()
    for d, n in copies.items():
        assert n <= 3
        words[by_id[d][3]] += n * len(by_id[d][1].split())
    for s in size:
        assert abs(words[s] - target[s]) <= 0.05 * target[s] + 30
    assert all(by_id[r[0]] == r for r in mixed)
    # ids
    assert Counter(r[0] for r in ids) == copies and all(r[-1] for r in ids) and set(copies) <= clean_ids


def test_registered(spark):
    import __spark_entry__ as E
    names = E.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))
    assert corpus_pipeline.ORACLE_SQL is None


def test_survives_without_the_subpackage(tmp_path):
    import os
    import shutil
    import subprocess
    import sys
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    shutil.copytree(root, tmp_path / "r", ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__"))
    code = "import __spark_entry__ as E; q = E.queries(); assert 'pipeline' not in q and not any(k.startswith('op1') for k in q); print(len(q))"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "r", capture_output=True, text=True, timeout=120)
    assert out.returncode == 0, out.stderr[-2000:]
