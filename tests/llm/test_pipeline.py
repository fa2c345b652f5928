"""The pipeline against plain versions of its stages, each judged on its own input."""

import hashlib
from collections import Counter

import pytest

import corpus_pipeline
from shardloom.llm import queries
from tests.llm.test_near_copies import plain_components
from tests.llm.test_operators import WORDS, plain_dedup


@pytest.fixture(scope="module")
def steps(spark, sf, tmp_path_factory):
    """The rows before the first stage and after each."""
    top, docs, out = tmp_path_factory.mktemp("stages"), spark.read.parquet(f"{sf}/documents.parquet"), []
    out.append(docs.collect())
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf).write.parquet(f"file://{top}/{i}")
        docs = spark.read.parquet(f"file://{top}/{i}")
        out.append(docs.collect())
    return out


def test_quality(steps, spark, sf):
    before, after = {r.doc_id for r in steps[0]}, {r.doc_id for r in steps[1]}
    labels = {r.doc_id: r for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    good = {i for i, r in labels.items() if r.quality == 1 and r.toxic == 0}
    bad = {i for i, r in labels.items() if r.quality == 0}
    assert after < before and len(good & after) >= 0.99 * len(good) and len(bad & after) <= 0.02 * len(bad) + 1
    assert {(r.doc_id, r.text) for r in steps[1]} <= {(r.doc_id, r.text) for r in steps[0]}


def test_near_duplicates(steps):
    """Five-word shingles at a Jaccard similarity of 0.8 or more, by brute force."""
    rows = sorted((r.doc_id, r.text) for r in steps[1])
    assert sorted(r.doc_id for r in steps[2]) == sorted(set(plain_components(rows)[1]))


def test_repeated_passages(steps):
    expected = plain_dedup({r.doc_id: r.text for r in steps[2]})
    left = {i for i, (n, gone, _) in expected.items() if gone == 0 or gone < n}
    assert {r.doc_id for r in steps[3]} == left
    for r in steps[3]:
        assert hashlib.sha256(" ".join(WORDS.findall(r.text)).encode()).hexdigest() == expected[r.doc_id][2]
        assert r.n_chars == len(r.text)


def test_mixture(steps):
    held, taken = {r.doc_id: r for r in steps[3]}, Counter(r.doc_id for r in steps[4])
    assert set(taken) <= set(held) and max(taken.values()) <= 2
    tokens = lambda rows: Counter({d: sum(len(WORDS.findall(r.text)) for r in rows if domain(r) == d) for d in ("web", "reference", "other")})
    domain = lambda r: "web" if int(r.source[3:]) < 10 else "reference" if int(r.source[3:]) < 15 else "other"
    assert sum(tokens(steps[4]).values()) <= sum(tokens(steps[3]).values())


def test_tokens(steps):
    v = queries.pieces_vocabulary()
    text = {r.doc_id: r.text for r in steps[4]}
    assert len(steps[5]) == len(steps[4])
    assert all(r.round_trip and v.decode(r.ids) == text[r.doc_id] for r in steps[5])


def test_run_equals_the_stages(steps, spark, sf):
    assert Counter((r.doc_id, tuple(r.ids)) for r in corpus_pipeline.run(spark, sf).collect()) == Counter((r.doc_id, tuple(r.ids)) for r in steps[5])
