"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing column names, for every operator and stage."""

import hashlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from shardloom.llm import html_extraction, mixing, pieces, quality_classifier, quality_rules, queries, sharding, simhash, substring_dedup, topk, url_filter

DOC = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"w{i}" for i in range(60_000)) + " ü" * 2000
ROWS = [
    (1, "one two three four five six seven eight nine ten eleven twelve", "en", "src1", 60), (1, "one two three four five six seven eight nine ten eleven twelve", "en", "src1", 60),
    (2, None, "en", "src1", None), (3, "", None, "src2", 0), (4, " \n\t ", "de", None, 4), (None, "an orphan text of some words", None, None, None), (None, None, None, None, None),
    (5, LONG, "fr", "src12", len(LONG)), (6, LONG + " end", "fr", "src12", len(LONG) + 4), (7, "x" * 100_000, "xx", "other", 100_000), (2**60 + 1, "wide id", "en", "src19", 7), (-3, "negative", "es", "src0", 8),
]
CLASH = ["_text", "_doc", "_row", "_rest", "_key", "_kind", "_order", "host", "path", "fp", "kept", "n_words", "epoch", "ids", "shard", "slot", "evidence", "_digest", "a.b", "component_id"]


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(ROWS, DOC).withColumns({c: F.lit("other") for c in CLASH}).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOC)


@pytest.fixture(scope="module")
def model(spark, sf):
    return quality_classifier.train(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet"))


@pytest.fixture(scope="module")
def vocabulary():
    return pieces.Vocabulary.load(queries.PIECES)


def ids(df):
    return sorted((r.doc_id for r in df.collect()), key=str)


ALL = sorted((r[0] for r in ROWS), key=str)


def test_simhash(rows, empty):
    got = simhash.components(rows)
    assert ids(got) == ALL
    by_id = {r.doc_id: r for r in got.collect()}
    assert {by_id[i].component_id for i in (2, 3, 4)} == {2} and by_id[2].fingerprint == "0" * 16
    assert by_id[5].component_id == by_id[6].component_id == 5
    assert by_id[2**60 + 1].component_id == 2**60 + 1
    assert simhash.components(empty).collect() == []


def test_component_of_rows_without_id(spark):
    df = spark.createDataFrame([(None, "a b c d"), (None, "a b c d"), (9, "z y x")], "doc_id long, text string")
    assert {(r.doc_id, r.component_id) for r in simhash.components(df).collect()} == {(None, None), (9, 9)}


def test_quality_classifier(rows, empty, model, spark):
    got = quality_classifier.classify(rows, model)
    assert ids(got) == ALL and set(CLASH) - {"evidence", "kept"} <= set(got.columns)
    assert all(r.kept is not None and 0 <= r.posterior <= 1 for r in got.collect())
    assert quality_classifier.classify(empty, model).collect() == []
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert all(r.kept for r in quality_classifier.classify(rows, quality_classifier.train(rows, labels)).collect())


def test_contradicting_and_null_labels(rows, spark):
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (5, None, 1), (6, 1, None), (None, 1, 0), (777, 0, 0)], "doc_id long, quality int, toxic int")
    assert quality_classifier.train(rows, labels) is not None


def test_html(spark):
    schema = "page_id long, url string, html string, host string, text string, template string"
    made = [(1, None, None), (2, "x", ""), (3, "http://h/", "<p>a"), (3, "http://h/", "<p>a"), (None, "http://h/", "<article>" + "<p>b</p>" * 5000), (5, "http://h/", "<div " * 1000), (6, "http://h/", "<" * 20000), (7, "http://h/", "<!-- never closed <p>z"), (8, "http://h/", "<p a='" + "x" * 50000)]
    df = spark.createDataFrame([(*r, "h", "t", "u") for r in made], schema)
    got = {r.page_id: r for r in html_extraction.extract(df).collect()}
    assert got[1].text == got[2].text == "" and got[1].n_chars == 0 and got[3].text == "a"
    assert got[None].text == "\n".join("b" * 5000) and got[7].text == ""
    assert len(html_extraction.extract(df).collect()) == len(made)
    assert html_extraction.extract(df.limit(0)).collect() == []


def test_urls(spark):
    df = spark.createDataFrame([(None, "http://a.com/en/"), (1, None), (1, None), (2, "http://" + "a." * 500 + "com/en/" + "y" * 5000)], "page_id long, url string").withColumns({c: F.lit("x") for c in ("host", "path", "rule", "verdict")})
    assert sorted((str(r.page_id), r.verdict) for r in url_filter.judge(df, queries.URL_RULES).collect()) == [("1", "allow"), ("1", "allow"), ("2", "block"), ("None", "block")]
    assert {r.verdict for r in url_filter.judge(df, []).collect()} == {"allow"}
    assert url_filter.judge(df.limit(0), queries.URL_RULES).collect() == []


def test_sharding(rows, empty):
    got = sharding.assign(rows, 4).collect()
    assert sorted((r.doc_id for r in got), key=str) == ALL
    for s in {r.shard for r in got}:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    assert {(r.size, r.text_crc32) for r in got if r.doc_id in (2, 3)} == {(1, 0)}
    assert sharding.assign(empty, 4).collect() == []


def test_substring_dedup(rows, empty):
    got = substring_dedup.deduplicate(rows, with_text=True)
    assert ids(got) == ALL and "a.b" in got.columns and got.columns.count("n_words") == 1
    by_id = {r.doc_id: r for r in got.collect()}
    assert by_id[6].n_removed == 62_000 and by_id[6].kept_text == "end" and by_id[6].lang == "fr"
    assert by_id[5].n_removed == 0 and by_id[5].kept_text == LONG
    assert by_id[2].n_words == 0 and by_id[2].kept_sha256 == hashlib.sha256(b"").hexdigest() and by_id[2].kept_text is None
    assert by_id[4].kept_text == " \n\t " and by_id[2**60 + 1].n_words == 2
    assert substring_dedup.deduplicate(empty).collect() == []


def test_top_k(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert topk.top_k(df, F.col("vec_id") % 50 == 0, 5).collect() == []
    df = spark.createDataFrame([(0, [1.0]), (0, [1.0]), (1, [1.0]), (2, [])], "vec_id long, embedding array<float>").withColumns({c: F.lit("x") for c in ("kind", "q", "vector", "score")})
    got = topk.top_k(df, F.col("vec_id") == 0, 5).collect()
    assert {(r.query_id, r.vec_id, r.score) for r in got} == {(0, 1, 65536), (0, 2, 0)}


def test_pieces(rows, empty, vocabulary):
    got = pieces.encode(rows, vocabulary)
    assert ids(got) == ALL and all(r.round_trip for r in got.collect())
    assert {r.n_tokens for r in got.collect() if r.doc_id in (2, 3)} == {0}
    back = {r.doc_id: r.text for r in pieces.decode(got, vocabulary).collect()}
    assert back[5] == LONG and back[2] == ""
    assert pieces.encode(empty, vocabulary).collect() == []


def test_quality_rules(rows, empty):
    got = quality_rules.judge(rows).collect()
    assert sorted((r.doc_id for r in got), key=str) == ALL
    by_id = {r.doc_id: r for r in got}
    assert by_id[2].base_failed and not by_id[2].kept and by_id[2].n_words == 0
    assert by_id[5].n_words == 62_000 and by_id[5].n_repeat_words == 2000
    assert quality_rules.judge(empty).collect() == []


def test_mixing(rows, empty):
    levels = queries.levels()
    got = mixing.mix(rows, levels, queries.WEIGHTS, fraction=1.0, epochs=1, seed=3)
    assert set(ids(got)) <= set(ALL) and got.columns.count("epoch") == 1
    everything = mixing.mix(rows, levels, {}, fraction=50.0, epochs=2, seed=3)
    assert {r.epoch for r in everything.where("doc_id = 5").collect()} == {0, 1}
    assert mixing.mix(empty, levels, queries.WEIGHTS).collect() == []


@pytest.mark.parametrize("stage", [s for s, _ in corpus_pipeline.STAGES])
def test_stages(rows, empty, stage, spark, sf):
    run = dict(corpus_pipeline.STAGES)[stage]
    got = run(spark, rows, sf)
    got.collect()
    assert run(spark, empty, sf).collect() == []
    if stage != corpus_pipeline.STAGES[-1][0]:
        assert got.columns == corpus_pipeline.COLUMNS


def test_one_row_of_a_group_stays(rows, spark, sf):
    """The row without an id or words is a copy of 2 and goes; the one with words of its own stays."""
    got = [r.doc_id for r in corpus_pipeline.near_duplicates(spark, rows, sf).collect()]
    assert sorted(got, key=str) == sorted([1, 2, None, 5, 7, 2**60 + 1, -3], key=str)
