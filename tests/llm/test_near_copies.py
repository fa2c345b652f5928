"""The pipeline's near-duplicates against brute force over all pairs."""

import random

import pytest

import corpus_pipeline
from shardloom.llm import near_copies
from tests.llm.test_operators import groups_of

#: With 48 shuffle partitions.
MOST_TASKS = 5_000


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def plain_components(rows):
    sets = [shingles(t) for _, t in rows]
    pairs = [(i, j) for i in range(len(rows)) for j in range(i) if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])]
    return pairs, [rows[g][0] for g in groups_of(len(rows), pairs)]


def made():
    """Bases with edits, some beyond the limit, on a passage that many share; and a chain."""
    rng = random.Random(5)
    words = lambda n: [f"w{rng.randrange(4000)}" for _ in range(n)]
    passage, texts = words(40), []
    for _ in range(12):
        base = words(rng.choice((3, 6, 30, 120))) + passage * rng.randrange(2)
        for edits in range(10):
            copy = list(base)
            for _ in range(edits // 2):
                copy[rng.randrange(len(copy))] = f"e{rng.randrange(10**6)}"
            texts.append(" ".join(copy))
    chain = words(100)
    for i in range(20):
        texts.append(" ".join(chain[i * 3 : i * 3 + 60]))
    rng.shuffle(texts)
    return [(i, t) for i, t in enumerate(texts)]


@pytest.mark.parametrize("common", [4, 10**9])
def test_components(spark, common, monkeypatch):
    monkeypatch.setattr(near_copies, "COMMON", common)
    rows = made()
    pairs, expected = plain_components(rows)
    assert len(pairs) > 100
    got = {r.doc_id: r.component_id for r in near_copies.components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[i] for i, _ in rows] == expected


def test_stage_finds_every_near_copy(spark, sf):
    """Copies at a Jaccard similarity of 0.83 that lie more than three bits of SimHash apart."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    _, expected = plain_components(rows)
    assert sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, sf).collect()) == sorted(set(expected))


@pytest.mark.parametrize("split", [1 << 13, 7])
def test_pairs_that_meet_become_rows_only_if_the_bounds_allow(spark, split, monkeypatch):
    """A shingle that many texts share makes no row for each two of them, and no near copies are lost."""
    monkeypatch.setattr(near_copies, "SPLIT", split)
    rng = random.Random(8)
    base = [f"w{i}" for i in range(60)]
    texts = [" ".join(base[:30] + [f"{i}x{j}" for j in range(30)]) for i in range(40)]
    for i in range(12):
        copy = list(base)
        copy[rng.randrange(60)] = f"e{i}"
        texts.append(" ".join(copy))
    rows = [(near_copies.node_of(t), x) for t, x in zip(texts, near_copies.shingle_sets(texts, near_copies.Hasher()), strict=True)]
    nodes = spark.createDataFrame([(k, near_copies.sketch(x)) for k, x in rows], "node long, sketch binary")
    met = spark.createDataFrame([(h, k, len(x), 0, k) for k, x in rows for h in (1, 2)], "h long, node long, n long, at long, root long")
    got = [tuple(r) for r in near_copies.meetings(met, nodes).collect()]
    alike = {(min(a, b), max(a, b)) for i, (a, x) in enumerate(rows) for b, y in rows[:i] if near_copies.similar(x.tobytes(), y.tobytes())}
    allowed = {(min(a, b), max(a, b)) for i, (a, x) in enumerate(rows) for b, y in rows[:i] if near_copies.may_share(near_copies.sketch(x), near_copies.sketch(y))}
    assert alike and alike <= set(got) == allowed
    assert len(allowed) < 200 < len(rows) * (len(rows) - 1) // 2


def test_few_rows_take_few_tasks(spark):
    """A few pairs don't run every shuffle partition's tasks at each step: each task costs the driver memory and the shared folder files."""
    rows, context = made(), spark.sparkContext
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    held = {"spark.sql.shuffle.partitions": "48", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        context.setJobGroup("few_rows", "near copies")
        kept = sorted(r.doc_id for r in near_copies.near_duplicates(docs).collect())
        tracker = context.statusTracker()
        stages = {s for j in tracker.getJobIdsForGroup("few_rows") for s in tracker.getJobInfo(j).stageIds}
        tasks = sum(info.numCompletedTasks for s in stages if (info := tracker.getStageInfo(s)))
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
        for k, v in before.items():
            spark.conf.set(k, v)
    assert kept == sorted(set(plain_components(rows)[1]))
    assert tasks < MOST_TASKS


def test_rows_of_one_id_are_judged_by_their_text(spark):
    """Two texts of one id both stay; a row without an id goes where another row of its component has one."""
    one, two, three = (" ".join(f"{c}{i}" for i in range(30)) for c in "abc")
    rows = [(5, one), (3, one), (5, two), (9, two), (None, two), (None, three), (None, three.upper()), (5, two), (7, ""), (8, None)]
    docs = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "doc_id long, text string, node int")
    got = near_copies.near_duplicates(docs)
    assert got.columns == ["doc_id", "text", "node"]
    kept = [(r.doc_id, (r.text or "").lower()) for r in got.collect()]
    assert sorted(kept, key=repr) == sorted([(3, one), (5, two), (None, three), (7, "")], key=repr)
    assert not near_copies.near_duplicates(docs.limit(0)).collect()


def test_the_sketch_never_drops_a_near_copy():
    rng = random.Random(3)
    hasher = near_copies.Hasher()
    for n in (1, 4, 5, 9, 60, 500, 5000):
        base = [f"w{rng.randrange(300)}" for _ in range(n)]
        for _ in range(20):
            other = list(base)
            for _ in range(rng.randrange(1 + n // 20)):
                other[rng.randrange(n)] = "x"
            x, y = near_copies.shingle_sets([" ".join(base), " ".join(other)], hasher)
            assert near_copies.may_share(near_copies.sketch(x), near_copies.sketch(y)) or not near_copies.similar(x.tobytes(), y.tobytes())
