"""Connected components of a table of links, by alternating large-star and small-star steps.

The links never leave the executors; each round is cut off by a checkpoint, and
only its count and checksum reach the driver. A list of links that was counted
and is short enough for one task needs no rounds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import counted, durable

def union(comp: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels (a component's smallest index) after linking a with b."""
    while True:
        ra, rb = comp[a], comp[b]
        apart = ra != rb
        if not apart.any():
            return comp
        a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
        np.minimum.at(comp, np.maximum(ra, rb), np.minimum(ra, rb))
        while (up := comp[comp]).tobytes() != comp.tobytes():
            comp = up


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, root) of all links (a, b), in one task."""
    ends = [(batch.column("a").to_numpy(), batch.column("b").to_numpy()) for batch in batches]
    a, b = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (zip(*ends, strict=True) if ends else ((), ())))
    nodes, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    comp = union(np.arange(len(nodes)), at[: len(a)], at[len(a) :])
    other = comp != np.arange(len(nodes))
    yield pa.RecordBatch.from_arrays([pa.array(nodes[other]), pa.array(nodes[comp[other]])], names=["node", "root"])


def _mark(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())


def _parents(links: DataFrame) -> DataFrame:
    return links.groupBy("a").agg(F.min("b").alias("p"))


def connected_components(links: DataFrame, at_once: int = 0) -> DataFrame:
    """(node, root) of every node in ``links`` (longs a, b; in any order, repeats allowed) but the roots; a root is its component's smallest node.

    Up to ``at_once`` different links are joined in one task (16 bytes a link), more by rounds of stars.
    """
    links = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    links, n = counted(links) if at_once else (durable(links), None)
    if n is not None and n <= at_once:
        return durable(links.coalesce(1).mapInArrow(_joined, "node long, root long"))
    mark = _mark(links)
    while True:
        # large star: a neighbour's own smallest neighbour takes its place
        parents = _parents(links).select(F.col("a").alias("b"), "p")
        links = links.join(parents, "b", "left").select("a", F.coalesce("p", "b").alias("b")).distinct()
        # small star: all smaller neighbours of a node meet at the smallest
        met = links.join(_parents(links), "a")
        pairs = F.explode(F.array(F.struct("a", F.col("p").alias("b")), F.struct(F.col("b").alias("a"), F.col("p").alias("b"))))
        links = durable(met.select(pairs.alias("e")).select("e.a", "e.b").where("a <> b").distinct())
        before, mark = mark, _mark(links)
        if mark == before:
            return links.select(F.col("a").alias("node"), F.col("b").alias("root"))
