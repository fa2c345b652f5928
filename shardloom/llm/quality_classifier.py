"""A quality classifier with hierarchical empirical Bayes over hosts and paths.

Document evidence: a logistic regression over word presence and a few
measures of style, fitted on a bounded sample of labelled documents (the
``max_labelled`` smallest hashes of their ids, of those as many in that order as
have ``max_bytes`` of features together), with weights for at most ``max_words``
words. A document is good if its
quality label is 1 and its toxicity label is not.

Site evidence: the documents' probabilities are summed by host and by path
below it (partial sums before the shuffle). A host's rate has a beta prior
around the global rate and a path's one around its host's posterior mean; each
level's prior strength is fitted by moments to the spread of its rates, so a
sparse site stays near what is above it.

Posterior: the document's log odds, moved by the difference between its path's
log odds and the global ones: the classifier's likelihood ratio with the path's
posterior mean as the prior. A document is kept if its posterior is at least
``threshold``.

Defined cases: a null text has no words and is judged by its style (all zero)
and site; null hosts and paths are values of their own; rows that share an id
are judged apart; labels that contradict each other count as not good, null
labels don't count; without labels of both kinds, all evidence is zero and all
documents are kept; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Hasher, append_columns, chunks, durable, mix64, packed, split_words, unpacked

#: Bins that words are hashed to.
BINS = 1 << 18
STYLE = 12
#: Bytes of a word's beginnings that count beside the word.
PREFIXES = (4, 5, 6)
#: What a word explains must be this many standard errors from 0, in this many documents.
LEAST_Z, LEAST_DOCS = 2.5, 5

#: Sites that are sent to every executor instead of joined by a shuffle.
MOST_BROADCAST = 100_000

_KIND = np.zeros(256, np.uint8)  # 1 upper case, 2 lower case, 3 digit, 4 symbol, 5 exclamation
for _chars, _k in ((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", 1), (b"abcdefghijklmnopqrstuvwxyz", 2), (b"0123456789", 3), (b"#*$%&|<>@^~_=+\\/{}[]", 4), (b"!?", 5)):
    _KIND[list(_chars)] = _k


def _bins(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - BINS.bit_length() + 1)).astype(np.int64)


def features(texts: list[bytes], hasher: Hasher) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Of each text: its style, and the sorted bins of its different words and longer words' beginnings, in lower case."""
    for begin, end in chunks([len(t) for t in texts]):
        part = texts[begin:end]
        data, starts, ends, n = split_words([t.lower() for t in part])
        bins = _bins(hasher.words(data, starts, ends))
        begun = [(np.flatnonzero(ends - starts > most), most) for most in PREFIXES]
        stems = [_bins(mix64(hasher.words(data, starts, ends, most)[at] + np.uint64(most))) for at, most in begun]
        cuts = [np.searchsorted(at, np.concatenate(([0], np.cumsum(n)))) for at, _ in begun]
        at = 0
        for i, (text, count) in enumerate(zip(part, n.tolist(), strict=True)):
            mine = np.sort(bins[at : at + count])
            lead = np.ones(count, bool)
            lead[1:] = mine[1:] != mine[:-1]
            different = mine[lead]
            kinds = np.bincount(_KIND[np.frombuffer(text, np.uint8)], minlength=6)[1:] / max(1, len(text))
            most = np.diff(np.append(np.flatnonzero(lead), count)).max(initial=0) / max(1, count)
            lines = [x for x in text.split(b"\n") if x]
            style = [np.log1p(count) / 10, len(different) / max(1, count), most, *kinds, 1 - len(set(lines)) / max(1, len(lines)), float(ends[at : at + count].sum() - starts[at : at + count].sum()) / max(1, count) / 10, text.count(b" | ") / max(1, count), 1.0]
            at += count
            yield np.array(style), np.unique(np.concatenate((different, *(b[c[i] : c[i + 1]] for b, c in zip(stems, cuts, strict=True)))))


@dataclass
class Model:
    """Weights of the style, and of the chosen bins (sorted)."""

    style: np.ndarray
    bins: np.ndarray
    words: np.ndarray
    seed: int

    def score(self, texts: list[str | None]) -> np.ndarray:
        """The log odds that each text is good."""
        out, hasher = [], Hasher(self.seed)
        for style, different in features([(t or "").encode() for t in texts], hasher):
            at = np.minimum(np.searchsorted(self.bins, different), max(0, len(self.bins) - 1))
            held = at[self.bins[at] == different] if len(self.bins) else at[:0]
            out.append(style @ self.style + self.words[held].sum())
        return np.array(out)


def _newton(x: np.ndarray, good: np.ndarray, penalty: np.ndarray, rounds: int = 25) -> np.ndarray:
    """Weights of a ridge logistic regression."""
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope, bend = x.T @ (good - p) - penalty * w, np.diag(penalty)
        for at in range(0, len(x), 2048):  # a block of rows at a time: no second copy of all
            part = x[at : at + 2048].astype(float)
            bend += (part * np.maximum(p * (1 - p), 1e-6)[at : at + 2048, None]).T @ part
        step = np.linalg.solve(bend, slope)
        w += step * min(1.0, 5 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-6:
            break
    return w


def fit(styles: np.ndarray, words: list[np.ndarray], good: np.ndarray, seed: int, ridge: float = 1.0, max_words: int = 512) -> Model:
    """A regression on the style, then on the style and the words that explain most of what it left (by the score test)."""
    n, n_good = len(good), int(good.sum())
    if not 0 < n_good < n:
        return Model(np.zeros(STYLE), np.zeros(0, np.int64), np.zeros(0), seed)
    penalty = np.full(STYLE, ridge / 100)
    penalty[-1] = 1e-6  # the constant
    p = 1 / (1 + np.exp(-np.clip(styles @ _newton(styles, good, penalty), -30, 30)))
    count, left, spread = np.zeros((3, BINS))
    for mine, y, q in zip(words, good, p, strict=True):  # a text's bins differ
        count[mine] += 1
        left[mine] += y - q
        spread[mine] += q * (1 - q)
    z = np.where(count >= LEAST_DOCS, np.abs(left) / np.sqrt(spread + 0.05), 0)
    bins = np.sort(np.argsort(-z, kind="stable")[: min(max_words, int((z >= LEAST_Z).sum()))])
    x = np.zeros((n, STYLE + len(bins)), np.float32)
    x[:, :STYLE] = styles
    for i, mine in enumerate(words):
        x[i, STYLE + np.flatnonzero(np.isin(bins, mine, assume_unique=True))] = 1
    w = _newton(x, good, np.concatenate((penalty, np.full(len(bins), ridge))))
    return Model(w[:STYLE], bins, w[STYLE:], seed)


def train(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", max_labelled: int = 12_000, seed: int = 7, max_words: int = 512, max_bytes: int = 64 << 20) -> Model:
    """A model fitted on a bounded sample of labelled documents; only their features reach the driver.

    The bounds are parameters: ``max_labelled`` documents, ``max_bytes`` of their
    features, ``max_words`` words with weights.
    """
    told = labels.where("quality IS NOT NULL").groupBy(F.col(key).alias("_id")).agg(F.min(((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0)).cast("int")).alias("good"))
    chosen = told.orderBy(F.xxhash64(F.lit(seed), "_id"), "_id").limit(max_labelled)  # the bound
    rows = docs.select(F.col(key).alias("_id"), F.col(text).cast("string").alias("_text")).join(F.broadcast(chosen), "_id").select("_id", "good", "_text")

    def compute(texts: list[str | None]) -> list[pa.Array]:
        found = list(features([(t or "").encode() for t in texts], Hasher(seed)))
        return [pa.array([s.tobytes() for s, _ in found], pa.binary()), pa.array([w.astype(np.int32).tobytes() for _, w in found], pa.binary())]

    made = durable(append_columns(rows, ["_text"], [("style", "binary"), ("words", "binary")], compute).withColumn("_order", F.xxhash64(F.lit(seed), "_id")))
    sizes = made.select("_order", (F.octet_length("words") + F.octet_length("style")).alias("n"))
    upto = F.sum("n").over(Window.orderBy("_order"))  # max_labelled narrow rows, about
    last = sizes.withColumn("upto", upto).where(F.col("upto") <= max_bytes).agg(F.max("_order")).first()[0]
    made = made.where(F.col("_order") <= F.lit(last)) if last is not None else made.limit(0)
    # a partition at a time, in an order that doesn't depend on the tasks'
    found = sorted((str(r["_id"]), bytes(r["words"]), bytes(r["style"]), r["good"]) for r in made.toLocalIterator())
    styles = np.array([np.frombuffer(r[2], np.float64) for r in found]).reshape(len(found), STYLE)
    return fit(styles, [np.frombuffer(r[1], np.int32) for r in found], np.array([r[3] for r in found], float), seed, max_words=max_words)


def _logit(p):
    return F.log(p / (1 - p))


def _strength(groups: DataFrame, mean: str) -> float:
    """The beta prior's strength around ``mean`` that explains the spread of n, good: within (Bernoulli) plus between groups."""
    dev = F.pow(F.col("good") / F.col("n") - F.col(mean), 2)
    noise = F.col(mean) * (1 - F.col(mean))
    row = groups.agg(F.sum(F.col("n") * dev), F.sum(noise), F.sum(F.col("n").cast("double")), F.avg(noise)).first()
    if not row[2] or not row[3]:
        return 1.0
    between = (row[0] - row[1]) / row[2]  # E[n dev^2] = noise + n * between
    return min(1e6, max(1.0, row[3] / between - 1)) if between > 0 else 1e6


def site_posteriors(scored: DataFrame) -> DataFrame:
    """(host, path, path_rate, global_rate) from rows with host, path and p."""
    paths = durable(scored.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("p").alias("good")))
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("good").alias("good"))
    total = hosts.agg(F.sum("n"), F.sum("good")).first()
    rate = min(max((total[1] or 0) / (total[0] or 1), 1e-4), 1 - 1e-4)
    hosts = hosts.withColumn("rate", F.lit(rate))
    k_host = _strength(hosts, "rate")
    hosts = hosts.select("host", ((F.col("good") + F.lit(rate * k_host)) / (F.col("n") + F.lit(k_host))).alias("host_rate"))
    paths = paths.alias("p").join(hosts.alias("h"), F.col("p.host").eqNullSafe(F.col("h.host"))).select("p.host", "p.path", "p.n", "p.good", F.least(F.greatest("h.host_rate", F.lit(1e-4)), F.lit(1 - 1e-4)).alias("host_rate"))
    k_path = _strength(paths, "host_rate")
    path_rate = (F.col("good") + F.col("host_rate") * F.lit(k_path)) / (F.col("n") + F.lit(k_path))
    return paths.select("host", "path", F.least(F.greatest(path_rate, F.lit(1e-4)), F.lit(1 - 1e-4)).alias("path_rate"), F.lit(rate).alias("global_rate"))


def classify(docs: DataFrame, model: Model, host: str = "source", path: str = "lang", text: str = "text", threshold: float = 0.5, with_rows: bool = False) -> DataFrame:
    """The rows of ``docs`` (without ``text`` unless ``with_rows``) with evidence, site_rate, posterior and kept.

    Without texts rows are scored once and checkpointed. With them they are scored
    once for the sites and again for the result: a copy of all texts on disk would
    cost more than the scores.
    """
    results = ["evidence", "site_rate", "posterior", "kept"]
    left_out = results if with_rows else [text, *results]
    rows = docs.select(packed(docs, left_out).alias("_row"), F.col(host).cast("string").alias("host"), F.col(path).cast("string").alias("path"), F.col(text).cast("string").alias("_text"))
    scored = append_columns(rows, ["_text"], [("evidence", "double")], lambda texts: [pa.array(model.score(texts), pa.float64())])
    if not with_rows:
        scored = durable(scored)
    sites = durable(site_posteriors(scored.select("host", "path", (1 / (1 + F.exp(-F.col("evidence")))).alias("p"))))
    few = sites.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST
    # few sites: documents stay where they are; else a hot site's partition is split by the adaptive join
    met = scored.alias("d").join((F.broadcast(sites) if few else sites).alias("s"), F.col("d.host").eqNullSafe(F.col("s.host")) & F.col("d.path").eqNullSafe(F.col("s.path")))
    odds = F.col("evidence") + _logit(F.col("path_rate")) - _logit(F.col("global_rate"))
    return met.select(*unpacked("d._row", docs, left_out), "evidence", F.col("path_rate").alias("site_rate"), (1 / (1 + F.exp(-odds))).alias("posterior")).withColumn("kept", F.col("posterior") >= threshold)
