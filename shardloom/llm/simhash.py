"""SimHash near-duplicates by a self-join of binary tries.

``fingerprints`` gives each text its 64-bit SimHash over word shingles.
``components`` links the different fingerprints at ``bits`` or fewer differing
bits and names each connected component by its smallest document.

The join. A link of d bits leaves at least one of d + 1 equal blocks of the
fingerprint untouched, so each fingerprint is rotated to start with each block
in turn, and the rotations are the paths of a trie whose upper levels are the
block number and its bits. Every subtree under a block is one unit of work. In
it, pairs of nodes are traversed together from the top: equal bits keep a
pair's error, different bits add one, and a pair over the budget is pruned with
everything below. Pairs with few leaves are compared directly, and pairs that
already lie in one component are skipped, so that a dense group costs far less
than all its pairs. A task returns a spanning forest of the links it finds: at
most one row for each fingerprint, whatever the number of links.

Subtrees of more than ``split`` fingerprints are dealt into parts by hash, and
each two parts meet in a task of their own, so no task grows with a hot block.
Equal fingerprints are one leaf, so copies cost one row.

Defined cases: null and empty texts have fingerprint zero and link like any
other; shorter texts are one shingle; a row with a null id gets the component
of its fingerprint (null if no document there has an id); repeated rows each
get a row; an empty table gives an empty result; extra columns are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import append_columns, durable
from .components import connected_components, union

#: Fingerprints to a batch of small units; node pairs that are traversed at once; leaf pairs that are compared directly.
BATCH, PAIRS, DIRECT = 1 << 16, 1 << 16, 64
#: Hot subtrees whose list is sent to every executor instead of joined by a shuffle.
MOST_BROADCAST = 100_000


def majority(hashes: np.ndarray) -> int:
    """The SimHash of some 64-bit hashes: a bit is 1 if set in over half of them."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), BATCH):
        part = hashes[at : at + BATCH].astype("<u8", copy=False)
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    """Unsigned SimHash: a bit is 1 if set in over half of the shingles' XXH64."""
    words = (text or "").encode().lower().split()  # bytes: A-Z only
    if not words:
        return 0
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return digest(joined, seed)
    gaps = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    starts, ends = [0, *(gaps + 1).tolist()], [*gaps.tolist(), len(joined)][shingle - 1 :]
    return majority(np.fromiter((digest(joined[s:e], seed) for s, e in zip(starts, ends)), "<u8", len(ends)))  # noqa: B905


def fingerprints(docs: DataFrame, text: str = "text", key: str = "doc_id", shingle: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, fp) of every row, fp as a signed long."""

    def compute(texts: list[str | None]) -> list[pa.Array]:
        return [pa.array(np.array([fingerprint(t, shingle, seed) for t in texts], np.uint64).view(np.int64))]

    return append_columns(docs.select(F.col(key).alias("doc_id"), F.col(text).cast("string").alias("text")), ["text"], [("fp", "long")], compute)


def _runs(comp: np.ndarray) -> np.ndarray:
    """For each index, where its run of equal labels ends."""
    ends = np.append(np.flatnonzero(comp[1:] != comp[:-1]) + 1, len(comp))
    return np.repeat(ends, np.diff(np.concatenate(([0], ends))))


def trie_join(values: np.ndarray, tops: np.ndarray, depth: int, bits: int) -> np.ndarray:
    """Components of the links within each subtree.

    values: uint64, different and sorted within each subtree; tops: where the
    subtrees begin, and the end; their values share the first ``depth`` bits.
    Returns for each value the first index of its component.
    """
    comp = np.arange(len(values))
    runs = _runs(comp)
    begin, end = tops[:-1], tops[1:]
    several = end - begin > 1
    zero = np.zeros(several.sum(), np.int64)
    stack = [(depth, begin[several], end[several], begin[several], end[several], zero)]
    zeros: dict[int, np.ndarray] = {}
    while stack:
        level, al, ah, bl, bh, err = stack.pop()
        if len(al) > PAIRS:  # a bounded block of node pairs at a time
            stack += [(level, *(x[PAIRS:] for x in (al, ah, bl, bh, err))), (level, *(x[:PAIRS] for x in (al, ah, bl, bh, err)))]
            continue
        joined = (runs[al] >= ah) & (runs[bl] >= bh) & (comp[al] == comp[bl])
        few = ((ah - al) * (bh - bl) <= DIRECT) | (level >= 64)
        at = few & ~joined
        if at.any():
            wide, n = (bh - bl)[at], ((ah - al) * (bh - bl))[at]
            k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            w = np.repeat(wide, n)
            i, j = np.repeat(al[at], n) + k // w, np.repeat(bl[at], n) + k % w
            near = (i != j) & (np.bitwise_count(values[i] ^ values[j]) <= bits)
            if near.any():
                comp = union(comp, i[near], j[near])
                runs = _runs(comp)
        deep = ~few & ~joined
        if not deep.any():
            continue
        al, ah, bl, bh, err = (x[deep] for x in (al, ah, bl, bh, err))
        if level not in zeros:
            zeros[level] = np.concatenate(([0], np.cumsum((values >> np.uint64(63 - level)) & np.uint64(1) == 0)))
        count = zeros[level]
        am, bm = al + count[ah] - count[al], bl + count[bh] - count[bl]
        same = al == bl  # a node with itself: its two children meet once
        nodes = [(al, am, bl, bm, err), (am, ah, bm, bh, err), (al, am, bm, bh, err + 1), tuple(x[~same] for x in (am, ah, bl, bm, err + 1))]
        block = [np.concatenate(x) for x in zip(*nodes, strict=True)]
        live = (block[1] > block[0]) & (block[3] > block[2]) & (block[4] <= bits)
        live &= ~((block[0] == block[2]) & (block[1] - block[0] < 2))
        if live.any():
            stack.append((level + 1, *(x[live] for x in block)))
    return comp


def _forest(rows: list[tuple[np.ndarray, ...]], width: int, bits: int) -> pd.DataFrame:
    task, shift, fp = (np.concatenate(x) for x in zip(*rows, strict=True))
    turned = np.where(shift == 0, fp, (fp << shift) | (fp >> ((np.uint64(64) - shift) & np.uint64(63))))
    order = np.lexsort((turned, task))
    task, fp, turned = task[order], fp[order], turned[order]
    tops = np.concatenate(([0], np.flatnonzero(task[1:] != task[:-1]) + 1, [len(task)]))
    comp = trie_join(turned, tops, width, bits)
    child = np.flatnonzero(comp != np.arange(len(comp)))
    return pd.DataFrame({"a": fp[child].view(np.int64), "b": fp[comp[child]].view(np.int64)})


def links(fps: DataFrame, bits: int = 3, split: int = 1 << 16) -> DataFrame:
    """A forest (a, b) over the different fingerprints in ``fps`` (column fp) with the components of all links of ``bits`` or fewer bits."""
    if not 0 <= bits <= 3:
        raise ValueError("bits must be from 0 to 3: four blocks of 16 bits must leave one untouched")
    blocks = 4
    width = 64 // blocks
    turns = fps.select("fp", F.explode(F.array(*[F.lit(i) for i in range(blocks)])).alias("turn"))
    start = F.shiftrightunsigned(F.col("fp"), 0)
    for i in range(blocks):
        start = F.when(F.col("turn") == i, F.shiftrightunsigned(F.col("fp"), 64 - width * (i + 1)).bitwiseAND(F.lit((1 << width) - 1))).otherwise(start)
    turns = turns.withColumn("start", start)
    hot = durable(turns.groupBy("turn", "start").count().where(F.col("count") > split))
    parts = hot.select("turn", "start", F.ceil(F.col("count") / split).cast("int").alias("parts"))
    few = parts.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST
    turns = turns.join(F.broadcast(parts) if few else parts, ["turn", "start"], "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    turns = turns.withColumn("part", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int"))
    turns = turns.withColumn("other", F.explode(F.expr("sequence(0, parts - 1)"))).where("parts = 1 OR other <> part")
    key = [F.col("turn"), F.col("start"), F.least("part", "other").alias("lo"), F.greatest("part", "other").alias("hi")]
    dealt = turns.select(*key, "fp").repartition("turn", "start", "lo", "hi").sortWithinPartitions("turn", "start", "lo", "hi")

    def join(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size, last, task = [], 0, None, -1
        for batch in batches:
            keys = batch[["turn", "start", "lo", "hi"]].to_numpy(np.int64)
            new = np.ones(len(batch), bool)
            new[1:] = (keys[1:] != keys[:-1]).any(1)
            if len(batch) and last is not None:
                new[0] = bool((keys[0] != last).any())
            if not len(batch):
                continue
            last = keys[-1]
            tasks = task + np.cumsum(new)
            task = int(tasks[-1])
            row = (tasks, (keys[:, 0] * width).astype(np.uint64), batch["fp"].to_numpy(np.int64).view(np.uint64))
            # a unit that goes on into the next batch is held; whole ones are joined when there are enough
            cut = int(np.flatnonzero(tasks == task)[0]) if size + len(batch) >= BATCH else 0
            if cut or (size >= BATCH and new[0]):
                held.append(tuple(x[:cut] for x in row))
                yield _forest(held, width, bits)
                held, size, row = [], 0, tuple(x[cut:] for x in row)
            held.append(row)
            size += len(row[0])
        if held:
            yield _forest(held, width, bits)

    return dealt.mapInPandas(join, "a long, b long")


def components(docs: DataFrame, text: str = "text", key: str = "doc_id", shingle: int = 3, bits: int = 3, seed: int = 42) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits) and component_id of every row."""
    rows = durable(fingerprints(docs, text, key, shingle, seed))
    first = durable(rows.groupBy("fp").agg(F.min("doc_id").alias("first")))
    roots = connected_components(links(first.select("fp"), bits))
    rooted = first.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    named = durable(rooted.groupBy("root").agg(F.min("first").alias("component_id")))  # written, so that a large component's rows can be split
    named = durable(rooted.select("fp", "root").join(named, "root").select("fp", "component_id"))
    return rows.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
