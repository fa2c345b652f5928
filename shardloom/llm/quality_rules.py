"""Quality rules with a verdict on hosts.

Every text gets the statistics that the rules judge. The rules' failures are
summed by host (partial sums before the shuffle); each host's failure rate is
shrunk towards all hosts' with a beta prior fitted to the rates by moments;
documents of a host whose posterior mean is over ``host_limit`` are rejected
with it. The host table joins back to the documents' narrow rows.

Defined cases: a null text has no words and fails; a null host is a host of
its own; the empty text, very long texts, repeated rows and an empty table
work; extra columns are dropped.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import append_columns, durable

#: Characters that count as symbols (fixed value).
SYMBOLS = b"#*$%&|<>"

#: Bytes that begin a character, in UTF-8.
_LEADING = bytes(b for b in range(256) if b & 0xC0 != 0x80)

STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def repeated_words(words: list[bytes], k: int) -> int:
    """Words within windows of k words that are found twice or more, exactly, whatever the number of different words."""
    n = len(words) - k + 1
    if n < 2:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter([number.setdefault(w, len(number)) for w in words], np.int64, len(words))
    base = len(number)
    if base == len(words):
        return 0
    key, span = ids[: len(ids)].copy(), 1
    held = base
    while span < k:  # windows of one word more; renumbered when the next product could overflow
        m = len(ids) - span
        if held > (2**62) // base:
            key, held = np.unique(key, return_inverse=True)[1], len(key)
        key = key[:m] * base + ids[span : span + m]
        held, span = held * base, span + 1
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    cover = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(twice)
    np.add.at(cover, at, 1)
    np.add.at(cover, at + k, -1)
    return int(np.count_nonzero(np.cumsum(cover)[:-1]))


def statistics(text: str | None, k: int = 5) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of a whole text."""
    data = (text or "").encode()
    words = data.split()
    joined = b"".join(words)
    chars = len(joined) if joined.isascii() else len(joined) - len(joined.translate(None, _LEADING))
    symbols = len(data) - len(data.translate(None, SYMBOLS))
    lines = [line for line in data.split(b"\n") if line.split(None, 1)] if b"\n" in data else []
    return len(words), chars, symbols, len(lines) - len(set(lines)), repeated_words(words, k)


def beta_prior(hosts: DataFrame, n: str, failed: str) -> tuple[float, float]:
    """(a, b) of the beta prior whose mean is the overall rate and whose spread matches the hosts' rates, by moments."""
    total = hosts.agg(F.sum(n), F.sum(failed)).first()
    if not total[0]:
        return 1.0, 1.0
    rate = total[1] / total[0]
    row = hosts.agg(F.sum(F.col(n) * F.pow(F.col(failed) / F.col(n) - F.lit(rate), 2)), F.sum(F.col(n).cast("double") * F.col(n)), F.count("*")).first()
    # E[sum n (r - rate)^2] = rate (1 - rate) (hosts - 1) + between-host variance * (total - sum n^2 / total)
    slack, noise = total[0] - row[1] / total[0], rate * (1 - rate)
    between = max(0.0, (row[0] - noise * max(0, row[2] - 1)) / slack) if slack > 0 else 0.0
    strength = min(1e6, max(1.0, noise / between - 1)) if between > 0 and noise > 0 else 1e6 if noise > 0 else 1.0
    rate = min(max(rate, 1e-6), 1 - 1e-6)
    return rate * strength, (1 - rate) * strength


def with_statistics(docs: DataFrame, host: str = "source", text: str = "text", key: str = "doc_id") -> DataFrame:
    """The key, host and statistics of every row."""
    rows = docs.select(F.col(key).alias("doc_id"), F.col(host).cast("string").alias("host"), F.col(text).cast("string").alias("text"))

    def measure(texts: list[str | None]) -> list[pa.Array]:
        found = np.array([statistics(t) for t in texts], np.int64).reshape(len(texts), -1)
        return [pa.array(found[:, i]) for i in range(len(STATS))]

    return append_columns(rows, ["text"], [(name, "long") for name in STATS], measure)


def host_verdicts(judged: DataFrame, host_limit: float) -> DataFrame:
    """Of each host: its documents, failures, posterior mean failure rate and whether it stands."""
    hosts = judged.groupBy("host").agg(F.count("*").alias("host_docs"), F.sum(F.col("base_failed").cast("long")).alias("host_failures"))
    a, b = beta_prior(hosts, "host_docs", "host_failures")
    posterior = (F.col("host_failures") + F.lit(a)) / (F.col("host_docs") + F.lit(a + b))
    return hosts.withColumn("host_rate", posterior).withColumn("host_stands", F.col("host_rate") <= F.lit(host_limit))


def judge(docs: DataFrame, host: str = "source", text: str = "text", key: str = "doc_id", min_words: int = 10, max_repeat_percent: int = 20, host_limit: float = 0.5) -> DataFrame:
    """Of each row: the statistics, base_failed, and kept (neither the rules nor the host's verdict are against it)."""
    rows = with_statistics(docs, host, text, key)
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    judged = durable(rows.withColumn("base_failed", failed))  # narrow; read for the hosts and for the verdicts
    hosts = host_verdicts(judged, host_limit)
    joined = judged.alias("d").join(hosts.alias("h"), F.col("d.host").eqNullSafe(F.col("h.host")), "left")
    return joined.select("d.doc_id", "d.host", *[f"d.{x}" for x in STATS], "d.base_failed", (~F.col("d.base_failed") & F.col("h.host_stands")).alias("kept"))
