"""The dealt methods' own parts, where they decide rows: site and host verdicts, pruning, an index that lives on, trees of many leaves."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from shardloom.llm import mixing, quality_classifier, quality_rules, substring_dedup, topk
from tests.llm.test_operators import made_texts, plain_dedup, results

# ---- quality classifier: hosts and paths


def plain_posteriors(rows):
    """Posterior of each row (host, path, evidence), by loops over lists."""
    p = [1 / (1 + math.exp(-e)) for _, _, e in rows]
    rate = min(max(sum(p) / len(p), 1e-4), 1 - 1e-4)
    clamp = lambda x: min(max(x, 1e-4), 1 - 1e-4)
    logit = lambda x: math.log(x / (1 - x))

    def strength(groups):  # of (n, good, mean)
        total = sum(n for n, _, _ in groups)
        noise = [m * (1 - m) for _, _, m in groups]
        between = (sum(n * (g / n - m) ** 2 for n, g, m in groups) - sum(noise)) / total
        return min(1e6, max(1.0, sum(noise) / len(noise) / between - 1)) if between > 0 else 1e6

    hosts, paths = {}, {}
    for (h, a, _), q in zip(rows, p, strict=True):
        for table, key in ((hosts, h), (paths, (h, a))):
            n, good = table.get(key, (0, 0.0))
            table[key] = (n + 1, good + q)
    k = strength([(n, g, rate) for n, g in hosts.values()])
    host_rate = {h: (g + rate * k) / (n + k) for h, (n, g) in hosts.items()}
    k = strength([(n, g, clamp(host_rate[h])) for (h, _), (n, g) in paths.items()])
    path_rate = {at: clamp((g + clamp(host_rate[at[0]]) * k) / (n + k)) for at, (n, g) in paths.items()}
    return [1 / (1 + math.exp(-(e + logit(path_rate[h, a]) - logit(rate)))) for h, a, e in rows]


def test_sites_decide_between_like_documents(spark, monkeypatch):
    """The whole of classify() against loops, on hosts and paths that differ; texts hold their own evidence."""
    rng = random.Random(2)
    rows = []
    for h in range(12):
        for path in range(3):
            bad = (0.05, 0.9)[h % 3 == 0] if path < 2 else 0.5
            for _ in range(rng.choice((1, 3, 40))):
                rows.append((f"h{h}" if h else None, f"p{path}", rng.gauss(-2.5 if rng.random() < bad else 1.5, 1.0)))
    monkeypatch.setattr(quality_classifier.Model, "score", lambda self, texts: np.array([float(t) for t in texts]))
    model = quality_classifier.Model(np.zeros(1), np.zeros(0, np.int64), np.zeros(0), 1)
    scored = spark.createDataFrame([(i, h, p, e) for i, (h, p, e) in enumerate(rows)], "doc_id long, source string, lang string, e double")
    # the model stands in for the text: its evidence is the number that the text is
    monkeypatch.setattr(quality_classifier, "append_columns", lambda df, *_: df.withColumn("evidence", F.col("_text").cast("double")).drop("_text"))
    got = {r.doc_id: r for r in quality_classifier.classify(scored.withColumn("text", F.col("e").cast("string")).drop("e"), model).collect()}
    expected = plain_posteriors(rows)
    assert all(math.isclose(got[i].posterior, expected[i], rel_tol=1e-9) and got[i].kept == (expected[i] >= 0.5) for i in range(len(rows)))
    by_document = [e >= 0 for _, _, e in rows]
    turned = sum(got[i].kept != by_document[i] for i in range(len(rows)))
    assert 5 < turned < len(rows) / 2  # the sites decide some rows, not all


# ---- quality rules: hosts


def test_host_verdicts_equal_loops(spark):
    rng = random.Random(7)
    rows = []
    for h in range(30):
        failing = rng.choice((0.02, 0.1, 0.8, 0.95))
        for _ in range(rng.choice((1, 4, 60))):
            rows.append((len(rows), f"h{h}" if h else None, "short" if rng.random() < failing else " ".join(f"w{rng.random()}" for _ in range(20))))
    got = {r.doc_id: r for r in quality_rules.judge(spark.createDataFrame(rows, "doc_id long, source string, text string")).collect()}
    n, bad = {}, {}
    for _, h, t in rows:
        n[h], bad[h] = n.get(h, 0) + 1, bad.get(h, 0) + (t == "short")
    total = sum(n.values())
    rate = sum(bad.values()) / total
    slack = total - sum(x * x for x in n.values()) / total
    between = max(0.0, (sum(n[h] * (bad[h] / n[h] - rate) ** 2 for h in n) - rate * (1 - rate) * (len(n) - 1)) / slack)
    k = min(1e6, max(1.0, rate * (1 - rate) / between - 1))
    stands = {h: (bad[h] + rate * k) / (n[h] + k) <= 0.5 for h in n}
    assert {i: got[i].kept for i, _, _ in rows} == {i: t != "short" and stands[h] for i, h, t in rows}
    assert sum(t != "short" and not stands[h] for _, h, t in rows) > 5


# ---- top-k


def plain_top(ids, grid, k, asked):
    out = []
    for q in asked:
        score = grid.T @ grid[:, q]
        order = [j for j in np.lexsort((ids, -score)) if ids[j] != ids[q]][:k]
        out.append([(int(ids[j]), int(score[j])) for j in order])
    return out


@pytest.mark.parametrize("clustered", [True, False])
def test_branch_and_bound_prunes_and_is_exact(clustered):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(64, 40))
    own = centres[:, rng.integers(0, 40, 4000)] + 0.15 * rng.normal(size=(64, 4000)) if clustered else rng.normal(size=(64, 4000))
    grid = np.floor(256 * own / np.sqrt(np.square(own).sum(0)))
    ids = rng.permutation(4000)
    blocks = [topk.Block(ids[a : a + 1000], grid[:, a : a + 1000]) for a in range(0, 4000, 1000)]
    asked, work = np.arange(0, 4000, 20), [0, 0]
    q, found, score = topk.search_blocks(ids[asked], grid[:, asked], blocks, 5, work)
    hits = [[] for _ in asked]
    for i, f, s in zip(q, found, score, strict=True):
        hits[i].append((int(f), int(s)))
    assert hits == plain_top(ids, grid, 5, asked)
    assert work[0] < (0.35 if clustered else 1.02) * work[1]  # vectors without any structure give nothing to prune by


def test_repeated_queries_each_have_a_whole_answer(spark):
    rng = np.random.default_rng(8)
    rows = [(int(i), [float(x) for x in rng.normal(size=8)]) for i in [0, 0, 50, 50, 50, *range(1, 30)]]
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 50 == 0, 5).collect()
    ids, grid = np.array([i for i, _ in rows]), np.floor(256 * np.array([v for _, v in rows])).T
    expected = [(int(ids[q]), r + 1, *hit) for q in range(5) for r, hit in enumerate(plain_top(ids, grid, 5, [q])[0])]
    assert sorted(tuple(r) for r in got) == sorted(expected)


# ---- substring dedup


def test_an_index_lives_on(spark, tmp_path):
    """Calls one after another, each of which opens the index by its path, equal one call over all; runs are compacted on the way."""
    texts, path = made_texts(), f"file://{tmp_path}/index"
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    got, edges = {}, [-20, -5, 10, 22, 40, 64]
    for low, high in zip(edges[:-1], edges[1:], strict=True):
        got |= results(substring_dedup.deduplicate(df.where(F.col("doc_id").between(low, high - 1)), batches=2, index=path))
        held = substring_dedup.WindowIndex.manifest(spark, path)
        assert sorted(f"{path}/{f}" for f, _ in held["runs"]) == sorted(f"file://{p}" for p in (tmp_path / "index").glob("run-*"))
    assert got == plain_dedup(texts)
    assert held["version"] == 5 and len(held["runs"]) < 5 and spark.sql("SHOW TABLES").count() == 0
    # a document that comes again is a repeat of itself
    again = results(substring_dedup.deduplicate(df.where("doc_id = 60"), index=path))
    assert again[60][1] == again[60][0] == 400
    with pytest.raises(ValueError):
        substring_dedup.deduplicate(df, k=5, index=path)


def test_an_index_grows_into_more_buckets(spark, tmp_path, monkeypatch):
    texts, path = made_texts(), f"file://{tmp_path}/index"
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = results(substring_dedup.deduplicate(df.where("doc_id < 20"), index=path))
    monkeypatch.setattr(substring_dedup, "MOST_BUCKET_BYTES", 64)
    got |= results(substring_dedup.deduplicate(df.where("doc_id >= 20"), index=path))
    assert got == plain_dedup(texts)
    assert substring_dedup.WindowIndex.manifest(spark, path)["buckets"] > 64


def test_a_call_that_breaks_off_leaves_the_index(spark, tmp_path, monkeypatch):
    texts, path = made_texts(), f"file://{tmp_path}/index"
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = results(substring_dedup.deduplicate(df.where("doc_id < 20"), index=path))
    honest = substring_dedup._fourth_step

    def breaks(*args):
        raise RuntimeError("lost")

    monkeypatch.setattr(substring_dedup, "_fourth_step", breaks)
    with pytest.raises(RuntimeError, match="lost"):
        substring_dedup.deduplicate(df.where("doc_id >= 20"), index=path)
    assert spark.sql("SHOW TABLES").count() == 0
    monkeypatch.setattr(substring_dedup, "_fourth_step", honest)
    got |= results(substring_dedup.deduplicate(df.where("doc_id >= 20"), index=path))
    assert got == plain_dedup(texts)


def test_a_passage_in_every_chunk_is_settled_on_the_way(spark):
    """What a bucket gets of a hash doesn't grow with the chunks that have it."""
    plan = substring_dedup.Plan(13, 8192, False, 1, np.zeros(0, np.uint64))
    passage = " ".join(f"p{i}" for i in range(40)).encode()
    rows = [(key, kind, blob) for doc in range(300) for kind, key, blob in plan.first_step([doc], [passage + b" end%d" % doc])]
    rows.sort(key=lambda r: r[:2])
    again = list(plan.deal_again(((kind, key, blob) for key, kind, blob in rows), settle=True))
    entries = substring_dedup.unpack([b for k, _, b in again if k == substring_dedup.ENTRY], substring_dedup.KINDS[substring_dedup.ENTRY])
    hits = substring_dedup.unpack([b for k, _, b in again if k == substring_dedup.HIT], substring_dedup.KINDS[substring_dedup.HIT])
    assert len(entries["hash"]) == 28 + 300 and (hits["sdoc"] == 0).all() and len(hits["doc"]) == 28 * 299


# ---- mixing


def plain_tree(rng, n):
    return {(f"d{i % 3}", f"l{i % 7}" if i % 11 else None, f"s{i}"): rng.randrange(0, 60) for i in range(n)}


def test_trees_planned_by_aggregation_equal_the_driver(spark):
    rng = random.Random(3)
    weights = {("d0",): 5, ("d1",): 2.5, ("d2",): 0, ("d0", "l1"): 4, ("d0", "l2"): 0, ("d1", "l3"): 0.75, ("d0", "l1", "s22"): 9}
    names = ["_level0", "_level1", "_level2"]
    for n, share in ((3, 0.5), (60, 0.9), (200, 2.0)):
        tree = plain_tree(rng, n)
        total = int(sum(tree.values()) * share)
        leaves = spark.createDataFrame([(*k, v) for k, v in tree.items()], "_level0 string, _level1 string, _level2 string, tokens long")
        got = {tuple(r[c] for c in names): r.budget for r in mixing.budgets_by_level(leaves, names, total, weights, 2).collect()}
        assert got == mixing.budgets(total, tree, weights, 2)


def test_150_000_leaves(spark, monkeypatch):
    docs = spark.range(150_000).selectExpr("id AS doc_id", "concat('d', id % 5) AS lang", "concat('host', id) AS source", "repeat('w ', cast(id % 7 AS int)) AS text")
    levels = {"lang": F.col("lang"), "source": F.col("source")}
    got = mixing.mix(docs, levels, {("d0",): 3}, fraction=0.5, epochs=2, seed=4)
    taken, given = got.agg(F.sum(F.col("doc_id") % 7), F.count("*")).first()
    assert 0 < taken <= 150_000 * 3 * 0.5 and given > 0
    few = docs.where("doc_id < 400")
    expected = sorted((r.doc_id, r.epoch) for r in mixing.mix(few, levels, {("d0",): 3}, 0.5, 2, 4).collect())
    monkeypatch.setattr(mixing, "MOST_LEAVES", 10)
    assert sorted((r.doc_id, r.epoch) for r in mixing.mix(few, levels, {("d0",): 3}, 0.5, 2, 4).collect()) == expected
