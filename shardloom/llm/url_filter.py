"""URL filters: a sorted digest array, memory-mapped and probed by binary search.

``DigestArray.build`` writes three files: the sorted 64-bit xxhash keys of all
entries, the offsets of the entries' strings, and the strings. Workers map the
files, probe a whole batch with ``numpy.searchsorted``, and compare the stored
string, so that a collision of keys is never taken for a match. The files
reach the executors through ``SparkContext.addFile``; nothing assumes a folder
that the driver and the executors share.

``judge`` probes, for each url, every suffix of its host that begins at a label
joined with the prefixes of its path that are as long as some rule's path.
The longest rule (host and path together, then host) that fits wins.

Defined cases: a null url, or one without ``://``, has an empty host and path
and fits no rule; empty labels fit no rule; an empty rule list or table works;
repeated rows are judged alike; extra columns are dropped.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import append_columns


@dataclass(frozen=True)
class Rule:
    """What is decided for a host with its subdomains, below a path prefix."""

    host: str
    path: str
    verdict: str

    @classmethod
    def parse(cls, text: str, verdict: str) -> Rule:
        host, slash, path = text.partition("/")
        return cls(host.lower(), slash + path, verdict)

    @property
    def name(self) -> str:
        return self.host + self.path


class DigestArray:
    """A read-only map from strings to small payloads over memory-mapped files."""

    SUFFIXES = ("keys", "offsets", "strings", "payloads")

    def __init__(self, stem: str):
        size = os.path.getsize(f"{stem}.keys") // 8
        load = lambda suffix, kind, n: np.memmap(f"{stem}.{suffix}", kind, "r", shape=(n,)) if n else np.zeros(0, kind)
        self.keys = load("keys", np.uint64, size)
        self.offsets = load("offsets", np.int64, size + 1)
        self.strings = load("strings", np.uint8, os.path.getsize(f"{stem}.strings"))
        self.payloads = load("payloads", np.int64, size)

    @classmethod
    def build(cls, entries: Iterable[tuple[str, int]], folder: str, digest=xxhash.xxh64_intdigest) -> str:
        """Write the files of a map and return their stem. Of an entry given twice, the last payload holds."""
        last = {text.encode(): payload for text, payload in entries}
        rows = sorted((digest(text), text, payload) for text, payload in last.items())
        stem = os.path.join(folder, f"digests-{uuid.uuid4().hex}")  # shipped files can't share a name
        np.array([r[0] for r in rows], np.uint64).tofile(f"{stem}.keys")
        np.concatenate(([0], np.cumsum([len(r[1]) for r in rows], dtype=np.int64))).astype(np.int64).tofile(f"{stem}.offsets")
        with open(f"{stem}.strings", "wb") as out:
            out.write(b"".join(r[1] for r in rows))
        np.array([r[2] for r in rows], np.int64).tofile(f"{stem}.payloads")
        return stem

    def find(self, texts: list[bytes], digest=xxhash.xxh64_intdigest) -> np.ndarray:
        """The payload of each text, -1 for those not held."""
        found = np.full(len(texts), -1, np.int64)
        if not len(self.keys) or not texts:
            return found
        wanted = np.fromiter(map(digest, texts), np.uint64, len(texts))
        at = np.searchsorted(self.keys, wanted, "left")
        live = np.flatnonzero((at < len(self.keys)) & (self.keys[np.minimum(at, len(self.keys) - 1)] == wanted))
        for i in live:
            k = at[i]
            while k < len(self.keys) and self.keys[k] == wanted[i]:  # equal keys stand together
                if self.strings[self.offsets[k] : self.offsets[k + 1]].tobytes() == texts[i]:
                    found[i] = self.payloads[k]
                    break
                k += 1
        return found


def ship(spark: SparkSession, stem: str) -> str:
    """Send a map's files to every executor; returns the name by which workers open it."""
    for suffix in DigestArray.SUFFIXES:
        spark.sparkContext.addFile(f"{stem}.{suffix}")
    return os.path.basename(stem)


_shipped: dict[tuple, str] = {}


def shipped(spark: SparkSession, rules: list[Rule]) -> str:
    """The name of the rules' map; the same rules are built and sent once for each application."""
    key = (spark.sparkContext.applicationId, *(r.name for r in rules))
    if key not in _shipped:
        _shipped[key] = ship(spark, DigestArray.build([(rule.name, i) for i, rule in enumerate(rules)], tempfile.mkdtemp(prefix="shardloom-rules-")))
    return _shipped[key]


@lru_cache(maxsize=4)
def opened(stem: str) -> DigestArray:
    """A map that a worker keeps open."""
    return DigestArray(stem)


def candidates(host: str, path: str, lengths: Iterable[int]) -> Iterator[str]:
    """Host suffixes with path prefixes, the longest together first, ties to the longer host."""
    hosts, rest = [], host
    while rest:
        hosts.append(rest)
        rest = rest.partition(".")[2]
    pairs = [(h, n) for h in hosts for n in lengths if n <= len(path)]
    pairs.sort(key=lambda p: (len(p[0]) + p[1], len(p[0])), reverse=True)
    for h, n in pairs:
        yield h + path[:n]


def judge(pages: DataFrame, rules: list[Rule], url: str = "url", key: str = "page_id", default: str = "allow") -> DataFrame:
    """Of each row: the key, host, path, rule (null if none fits) and verdict (that rule's, else ``default``)."""
    spark = pages.sparkSession
    name = shipped(spark, rules)
    lengths = sorted({len(rule.path) for rule in rules}, reverse=True)
    after = F.when(F.instr(F.col(url).cast("string"), "://") > 0, F.expr(f"substring(cast(`{url}` AS string), instr(cast(`{url}` AS string), '://') + 3)"))
    host = F.coalesce(F.translate(F.regexp_extract(after, r"^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))
    path = F.coalesce(F.regexp_extract(after, r"^[^/?#]*([^?#]*)", 1), F.lit(""))
    names, verdicts = [r.name for r in rules], [r.verdict for r in rules]

    def probe(hosts: list[str], paths: list[str]) -> list[pa.Array]:
        table = opened(os.path.join(os.path.dirname(SparkFiles.get(f"{name}.keys")), name))
        asked, ends = [], [0]
        for h, p in zip(hosts, paths, strict=True):
            asked += [text.encode() for text in candidates(h, p, lengths)]
            ends.append(len(asked))
        found, chosen = table.find(asked), []
        for begin, end in zip(ends[:-1], ends[1:], strict=True):
            hits = np.flatnonzero(found[begin:end] >= 0)  # the first is the longest
            chosen.append(int(found[begin + hits[0]]) if len(hits) else -1)
        fit = [names[i] if i >= 0 else None for i in chosen]
        return [pa.array(fit, pa.string()), pa.array([verdicts[i] if i >= 0 else default for i in chosen], pa.string())]

    rows = pages.select(F.col(key).alias("page_id"), host.alias("host"), path.alias("path"))
    return append_columns(rows, ["host", "path"], [("rule", "string"), ("verdict", "string")], probe, keep=["page_id", "host", "path"])
