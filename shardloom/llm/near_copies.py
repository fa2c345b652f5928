"""Near-duplicate removal on SimHash: texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

1. Every text becomes a node: the hash of its words, its SimHash over the
   shingles, their number and a sketch of them.
2. The trie self-join links fingerprints at ``bits`` or fewer differing bits. It
   finds about half of the near copies, and those at a fraction of the cost.
3. Near copies may lie further apart than any budget that a trie can prune by:
   at a similarity of 0.8 a bit differs with probability 0.15. The rest is
   therefore found exactly. In any one order of all shingles, two near copies
   share a shingle among the first ``n // 5 + 1`` of each, n being a set's size.
   The order is by the number of texts that have a shingle, counted over all of
   them in hash buckets: those of one text alone come first and can't be shared,
   so that a text with over a fifth of its own meets no other. (Shingles that
   are common in a sample aren't counted but come last; the sample changes the
   time taken, never the pairs.) Texts that share a shingle of their prefixes
   meet at it. Only components are wanted: where all that meet are in one
   component already, nothing is left to do; else all are compared with one of
   them, twice, and then pairs of different components, where they meet: only
   those that the sketches allow become rows.
4. Every pair, from either way, must pass two tests: the sketches' bound (the
   shingles counted in ``BINS`` bins: two sets share at most the sum of the
   smaller counts) and its whole sets. Whole sets are made for pairs alone that
   pass the bound.

Defined cases: words are those of SimHash (A-Z made small); texts with the same
words are one node, so copies cost one row; a text of fewer than five words is
one shingle, and texts without words are copies of each other; a row with a null
id gets the component of its text (null if no document there has an id) and
stays only where no row of its component has one; rows that share an id are
judged each by its own text; repeated rows each get a row; an empty table gives
an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Hasher, append_columns, chunks, counted, discard_table, durable, packed, sliced, split_words, tasks_for, written
from .components import connected_components
from .simhash import links as trie_links
from .simhash import majority
from .substring_dedup import CHUNK, ENTRY, ROWS, Plan, _batch, blobs_of, buckets_for, one_by_one, pack, take, unpack

SHINGLE = 5
#: Of so many texts one is in the sample (``SAMPLE`` texts at least); a shingle that is common in it comes last, and how many of those are held.
EVERY, SAMPLE, COMMON, MOST_COMMON = 64, 6_000, 3, 200_000
#: Rows of a list that is sent to every executor by joins, or links that are joined in one task; longer lists are shuffled, by rounds.
MOST_SENT = 1_000_000
#: Pairs whose sketches or whole sets a task compares.
TASK_PAIRS = 512
#: Texts of a shingle that are compared in one task.
SPLIT = 1 << 13
#: Bins of a sketch, and the largest set that has one; larger sets go straight to the whole comparison.
BINS, MOST_SKETCHED = 256, 1 << 20


def node_of(text: str | None) -> int:
    """A signed 64-bit hash of the text's words."""
    return int(np.uint64(xxhash.xxh64_intdigest(b" ".join((text or "").encode().lower().split()))).view(np.int64))


def shingle_sets(texts: list[str | None], hasher: Hasher) -> Iterator[np.ndarray]:
    """The sorted hashes of each text's different shingles."""
    small = [(t or "").encode().lower() for t in texts]
    for begin, end in chunks([len(t) for t in small]):
        data, starts, ends, counts = split_words(small[begin:end])
        windows = hasher.windows(hasher.words(data, starts, ends), SHINGLE)
        for i, at, n in zip(range(begin, end), np.cumsum(counts) - counts, counts, strict=True):
            yield np.unique(windows[at : at + n - SHINGLE + 1]) if n >= SHINGLE else np.array([node_of(texts[i])], np.int64).view(np.uint64)


def sketch(shingles: np.ndarray) -> bytes:
    """How many of the shingles are in each bin; nothing for a very large set."""
    if len(shingles) > MOST_SKETCHED:
        return b""
    return np.minimum(np.bincount((shingles >> np.uint64(56)).astype(np.int64), minlength=BINS), 65535).astype("<u2").tobytes()


def _common(texts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    every = max(1, min(EVERY, texts.count() // SAMPLE))
    some = texts.select("text").where(F.pmod(F.xxhash64("text"), F.lit(every)) == 0).distinct()

    def shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for batch in sliced(batches):
            found = np.concatenate([np.zeros(0, np.uint64), *shingle_sets(batch.column("text").to_pylist(), hasher)])
            yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64))], names=["h"])

    top = some.mapInArrow(shingles, "h long").groupBy("h").count().where(F.col("count") >= COMMON)
    table = top.orderBy(F.desc("count"), "h").limit(MOST_COMMON).toArrow()
    h, n = table["h"].to_numpy().astype(np.int64).view(np.uint64), table["count"].to_numpy().astype(np.int64)
    order = np.argsort(h)
    return h[order], n[order]


def described(texts: DataFrame) -> DataFrame:
    """doc_id, node, n (the set's size), fp (its SimHash) and sketch of every row of (doc_id, text)."""
    hasher = Hasher()

    def compute(rows: list[str | None]) -> list[pa.Array]:
        node, n, fp, sketches = [], [], [], []
        for text, shingles in zip(rows, shingle_sets(rows, hasher), strict=True):
            node.append(node_of(text))
            n.append(len(shingles))
            fp.append(majority(shingles))
            sketches.append(sketch(shingles))
        return [pa.array(node, pa.int64()), pa.array(n, pa.int64()), pa.array(np.array(fp, np.uint64).view(np.int64)), pa.array(sketches, pa.binary())]

    return append_columns(texts, ["text"], [("node", "long"), ("n", "long"), ("fp", "long"), ("sketch", "binary")], compute, keep=["doc_id"])


#: Packed rows of a chunk of texts, in its order: the nodes, their common shingles, and shingles that other texts have too.
NODES = [("node", "<i8"), ("n", "<u4")]
COMMON_OF = [("at", "<u4"), ("h", "<u8")]
SHARED = [("doc", "<i8"), ("at", "<u4"), ("h", "<u8"), ("df", "<u4")]
CHUNKS = "kind int, chunk long, blob binary"


def prefixes(texts: DataFrame) -> tuple[DataFrame, int]:
    """(h, node, n, at): of each text's prefix the shingles that another may share, and their places in it; and the number of these rows.

    A chunk of texts sends its shingles, sorted and packed, to hash buckets; a
    bucket counts them and returns to each chunk those of several texts.
    """
    common, counts = _common(texts)
    held = texts.sparkSession.sparkContext.broadcast((common, counts))  # bounded by MOST_COMMON
    total = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    plan, hasher = Plan(SHINGLE, buckets_for(total), False, 1, np.zeros(0, np.uint64)), Hasher()

    def packed_chunk(chunk: int, rows: list[str | None]) -> Iterator[tuple[int, int, bytes]]:
        """The chunk's nodes and common shingles (kind -1, -2), and its entries for the buckets."""
        common, _ = held.value
        seen: dict[int, str | None] = {}
        for text in rows:
            seen.setdefault(node_of(text), text)
        sets = list(shingle_sets(list(seen.values()), hasher))
        size = np.array([len(x) for x in sets], np.int64)
        h, at = np.concatenate([np.zeros(0, np.uint64), *sets]), np.repeat(np.arange(len(sets)), size)
        known = np.zeros(len(h), bool)
        if len(common):
            known = common[np.minimum(np.searchsorted(common, h), len(common) - 1)] == h
        yield -1, chunk, pack({"node": np.array(list(seen), np.int64), "n": size}, NODES)
        yield -2, chunk, pack({"at": at[known], "h": h[known]}, COMMON_OF)
        order = np.argsort(h[~known], kind="stable")
        n = len(order)
        yield from plan.deal({"hash": h[~known][order], "doc": np.full(n, chunk), "tag": np.zeros(n, np.uint32), "pos": at[~known][order]}, ENTRY)

    def pack_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        chunk, rows, size = (context.partitionId() if context else 0) << 32, [], 0
        for batch in sliced(batches):
            for text in batch.column("text").to_pylist():
                rows.append(text)
                size += len(text or "")
                if size >= CHUNK:
                    yield _wide(packed_chunk(chunk, rows))
                    chunk, rows, size = chunk + 1, [], 0
        if rows:
            yield _wide(packed_chunk(chunk, rows))

    def count(rows: pa.Table) -> pa.Table:
        table = unpack(blobs_of(rows), plan.kinds[ENTRY])
        order = np.argsort(table["hash"], kind="stable")
        h = table["hash"][order]
        new = np.ones(len(h), bool)
        new[1:] = h[1:] != h[:-1]
        df = np.diff(np.append(np.flatnonzero(new), len(h)))
        df = np.repeat(df, df)
        several = df > 1
        table, df = take(table, order[several]), df[several]
        out = {"doc": table["doc"], "at": table["pos"], "h": table["hash"], "df": df.astype(np.uint32)}
        order = np.argsort(out["doc"], kind="stable")
        out = take(out, order)
        edges = np.concatenate(([0], np.flatnonzero(np.diff(out["doc"])) + 1, [len(order)])) if len(order) else [0]
        found = [(0, int(out["doc"][b]), pack({n: c[b:e] for n, c in out.items()}, SHARED)) for b, e in zip(edges[:-1], edges[1:], strict=True)]
        return pa.Table.from_batches([_chunk_rows(found)])

    def choose(rows: pa.Table) -> pa.Table:
        common, counts = held.value
        kinds = rows.column("kind").to_numpy()
        part = lambda kind, columns: unpack(rows.filter(pa.array(kinds == kind)).column("blob").to_pylist(), columns)
        nodes, last, shared = part(-1, NODES), part(-2, COMMON_OF), part(0, SHARED)
        h, at = np.concatenate((shared["h"], last["h"])), np.concatenate((shared["at"], last["at"])).astype(np.int64)
        rank = np.concatenate((shared["df"].astype(np.int64), (1 << 40) + (counts[np.searchsorted(common, last["h"])] if len(last["h"]) else np.zeros(0, np.int64))))
        order = np.lexsort((h, rank, at))
        h, at = h[order], at[order]
        mine = np.bincount(at, minlength=len(nodes["n"]))
        n = nodes["n"].astype(np.int64)
        place = (n - mine)[at] + np.arange(len(at)) - (np.cumsum(mine) - mine)[at]
        keep = place < (n // 5 + 1)[at]
        return pa.table({"h": h[keep].view(np.int64), "node": nodes["node"][at[keep]], "n": n[at[keep]], "at": place[keep]})

    sent = written(texts.select("text").mapInArrow(pack_texts, f"{ROWS}, chunk long"), "entries")
    entries = one_by_one(plan, sent.where("kind >= 0").select("kind", "key", "blob"))
    back = entries.groupBy("key").applyInArrow(lambda rows: count(rows), CHUNKS)
    own = sent.where("kind < 0").select("kind", "chunk", "blob")
    found = counted(own.unionAll(back).groupBy("chunk").applyInArrow(lambda rows: choose(rows), "h long, node long, n long, at long").dropDuplicates(["h", "node"]))  # a node may be in several chunks
    discard_table(sent)
    return found


def _chunk_rows(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    kind, chunk, blob = zip(*rows) if rows else ((), (), ())  # noqa: B905
    return pa.RecordBatch.from_arrays([pa.array(kind, pa.int32()), pa.array(chunk, pa.int64()), pa.array(blob, pa.binary())], names=["kind", "chunk", "blob"])


def _wide(rows: Iterator[tuple[int, int, bytes]]) -> pa.RecordBatch:
    """Packed rows by bucket, and those of a chunk itself."""
    rows = list(rows)
    batch = _batch([(kind, key if kind >= 0 else 0, blob) for kind, key, blob in rows])
    return pa.RecordBatch.from_arrays([*batch.columns, pa.array([None if kind >= 0 else key for kind, key, _ in rows], pa.int64())], names=["kind", "key", "blob", "chunk"])


def _enough(a: str, b: str) -> Column:
    """Whether two sets can share four ninths of their sizes' sum if their first common shingle is at ``at`` in each."""
    return F.expr(f"9 * least({a}n - {a}at, {b}n - {b}at) >= 4 * ({a}n + {b}n)")


def _small(df: DataFrame) -> DataFrame:
    """A counted narrow table: sent to every executor by the joins that use it, if it is short enough."""
    df, rows = counted(df)
    return F.broadcast(df) if rows <= MOST_SENT else df


def _ordered(a: str, b: str) -> list[Column]:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def _judged(met: DataFrame, left: str, right: str, test) -> DataFrame:
    """The pairs (a, b) whose columns ``left`` and ``right`` pass the test."""

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            keep = [test(x, y) for x, y in zip(batch.column(left).to_pylist(), batch.column(right).to_pylist(), strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return met.select("a", "b", left, right).mapInArrow(judge, "a long, b long")


def may_share(x: bytes, y: bytes) -> bool:
    """Whether two sets can be near copies by their sketches."""
    if not x or not y:
        return True
    x, y = np.frombuffer(x, "<u2").astype(np.int64), np.frombuffer(y, "<u2").astype(np.int64)
    return max(x.max(), y.max()) == 65535 or bool(9 * np.minimum(x, y).sum() >= 4 * (x.sum() + y.sum()))


def _met_in(group: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of a group's rows that are of different components and pass the bounds of places and sketches."""
    node, n, at, root = (group.column(c).to_numpy().astype(np.int64) for c in ("node", "n", "at", "root"))
    held = group.column("sketch").to_pylist()
    counts = np.stack([np.frombuffer(x or bytes(2 * BINS), "<u2") for x in held])
    free = np.array([not x for x in held]) | (counts.max(1) == 65535)
    total, rest, a, b = counts.sum(1, dtype=np.int64), n - at, [], []
    for i in range(len(node) - 1):
        j = i + 1 + np.flatnonzero((root[i + 1 :] != root[i]) & (9 * np.minimum(rest[i], rest[i + 1 :]) >= 4 * (n[i] + n[i + 1 :])))
        if len(j):
            j = j[free[i] | free[j] | (9 * np.minimum(counts[i], counts[j]).sum(1, dtype=np.int64) >= 4 * (total[i] + total[j]))]
            a.append(np.full(len(j), node[i]))
            b.append(node[j])
    a, b = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (a, b))
    return np.minimum(a, b), np.maximum(a, b)


def meetings(met: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs (a, b) of different components that meet in ``met`` (h, node, n, at, root) and that the bounds allow.

    All rows of a shingle are compared where they lie, and only pairs that pass
    are rows: a shingle's pairs grow with the square of its texts. Shingles of
    over ``SPLIT`` texts are dealt in parts, every two parts to a task.
    """
    wide = nodes.select("node", "sketch").join(_small(met.select("node").distinct()), "node")
    parts = _small(met.groupBy("h").count().where(F.col("count") > SPLIT).select("h", F.ceil(F.col("count") / SPLIT).cast("int").alias("parts")))
    rows = met.join(wide, "node").join(parts, "h", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    rows = rows.withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.expr("sequence(0, parts - 1)"))).where("parts = 1 OR other <> part")
    rows = rows.select("h", F.least("part", "other").alias("lo"), F.greatest("part", "other").alias("hi"), "node", "n", "at", "root", "sketch")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pairs(table: pa.Table, edges: np.ndarray) -> pa.RecordBatch:
            found = [_met_in(table.slice(x, y - x)) for x, y in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True) if y - x > 1]
            a, b = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (zip(*found, strict=True) if found else ((), ())))
            each = np.unique(np.stack((a, b)), axis=1)
            return pa.RecordBatch.from_arrays([pa.array(each[0]), pa.array(each[1])], names=["a", "b"])

        left = None  # a shingle that goes on into the next batch
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = pa.concat_tables([left, table]).combine_chunks() if left is not None else table
            if not table.num_rows:
                continue
            keys = np.stack([table.column(c).to_numpy().astype(np.int64) for c in ("h", "lo", "hi")])
            edges = np.concatenate(([0], np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(0)) + 1))
            left = table.slice(int(edges[-1]))
            if len(edges) > 1:
                yield pairs(table, edges)
        if left is not None:
            yield pairs(left, np.array([0, left.num_rows]))

    return rows.repartition("h", "lo", "hi").sortWithinPartitions("h", "lo", "hi").mapInArrow(compare, "a long, b long")


def similar(x: bytes, y: bytes) -> bool:
    """Whether two sets have a Jaccard similarity of 0.8 or more."""
    x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
    return bool(9 * len(np.intersect1d(x, y, assume_unique=True)) >= 4 * (len(x) + len(y)))


def sets_of(wanted: DataFrame, texts: DataFrame, tasks: int) -> DataFrame:
    """(node, shingles) of the wanted nodes (node, first: the smallest id of its rows), made by ``tasks`` tasks."""
    hasher = Hasher()
    ids = _small(wanted.select(F.col("first").alias("_first")).distinct())
    some = texts.join(ids, F.col("doc_id").eqNullSafe(F.col("_first")), "left_semi")
    one = append_columns(some, ["text"], [("node", "long"), ("text", "string")], lambda rows: [pa.array([node_of(t) for t in rows], pa.int64()), pa.array(rows, pa.string())], keep=[])
    one = one.join(_small(wanted.select("node")), "node", "left_semi").groupBy("node").agg(F.first("text").alias("text")).coalesce(tasks)
    return append_columns(one, ["text"], [("shingles", "binary")], lambda rows: [pa.array([s.tobytes() for s in shingle_sets(rows, hasher)], pa.binary())])


def near(pairs: DataFrame, nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """Of the pairs (a, b) of nodes those that are near copies.

    What is made for the pairs is made by as many tasks as they need, so that a
    few pairs don't run every partition's tasks at each step.
    """
    pairs, rows = counted(pairs.where("a <> b").distinct())
    tasks = tasks_for(rows, TASK_PAIRS)
    # of the nodes only those that are in a pair: few of them are sent to the nodes, which then stay where they are
    held = durable(nodes.join(_small(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()), "node").select("node", "first", "sketch")).coalesce(tasks)
    met = pairs.join(held.select(F.col("node").alias("a"), F.col("sketch").alias("of_a")), "a").join(held.select(F.col("node").alias("b"), F.col("sketch").alias("of_b")), "b")
    left = durable(_judged(met.coalesce(tasks), "of_a", "of_b", may_share))
    wanted = left.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    sets = durable(sets_of(durable(held.select("node", "first").join(wanted, "node").coalesce(tasks)), texts, tasks))
    met = left.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("of_a")), "a").join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("of_b")), "b")
    return durable(_judged(met.coalesce(tasks), "of_a", "of_b", similar))


def links(nodes: DataFrame, texts: DataFrame, bits: int = 3) -> DataFrame:
    """Links (a, b) with the components of all near copies among ``nodes``."""
    # the trie: fingerprints, and the nodes that share one
    heads, _ = counted(nodes.groupBy("fp").agg(F.min("node").alias("head")))
    alike = nodes.select("node", "fp").join(heads, "fp").select(*_ordered("node", "head"))
    forest = trie_links(heads.select("fp"), bits)
    forest = forest.join(heads.select(F.col("fp").alias("a"), F.col("head").alias("x")), "a").join(heads.select(F.col("fp").alias("b"), F.col("head").alias("y")), "b")
    pairs = alike.unionByName(forest.select(*_ordered("x", "y")))
    # the rest: nodes that share a shingle of their prefixes
    at, rows = prefixes(texts)
    tasks = tasks_for(rows)  # what follows has no more rows, but for pairs
    shared = _small(at.groupBy("h").count().where("count > 1").select("h").coalesce(tasks))
    met, found = durable(at.join(shared, "h")), None
    for turn in range(3):
        new = near(pairs, nodes, texts)
        found = new if found is None else found.unionByName(new)
        roots = connected_components(found, MOST_SENT)
        rooted = met.select("h", "node", "n", "at").join(_small(roots), "node", "left").withColumn("root", F.coalesce("root", "node"))
        mixed = _small(rooted.groupBy("h").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("h").coalesce(tasks))
        met = durable(rooted.join(mixed, "h").select("h", "node", "n", "at", "root"))
        if turn == 2:
            break
        # all that meet with one of them: the same wherever the same texts meet
        order = F.struct(F.xxhash64(F.lit(turn), "node"), F.col("node"))
        first = met.groupBy("h").agg(F.min_by(F.struct("node", "n", "at", "root"), order).alias("c")).select("h", "c.*")
        pairs = met.alias("x").join(first.alias("y"), "h").where("x.root <> y.root").where(_enough("x.", "y.")).select(*_ordered("x.node", "y.node"))
    return found.unionByName(near(meetings(met, nodes), nodes, texts))


def components(docs: DataFrame, text: str = "text", key: str = "doc_id", bits: int = 3) -> DataFrame:
    """doc_id, node (the hash of the text's words), component_id and stays (the component's row with the smallest id, ties to the smallest node) of every row."""
    texts = docs.select(F.col(key).alias("doc_id"), F.col(text).cast("string").alias("text"))
    wide = written(described(texts), "described")
    rows = durable(wide.select("doc_id", "node"))
    nodes = written(wide.groupBy("node").agg(F.min("doc_id").alias("first"), F.first(F.struct("n", "fp", "sketch")).alias("d")).select("node", "first", "d.*"), "nodes")
    discard_table(wide)
    roots = _small(connected_components(links(nodes, texts, bits), MOST_SENT))
    rooted, count = counted(nodes.select("node", "first").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")))
    tasks = tasks_for(count)
    named = durable(rooted.groupBy("root").agg(F.min(F.struct(F.col("first").isNull().alias("none"), "first", "node")).alias("best")).coalesce(tasks))  # written, so that a large component's rows can be split
    named = durable(rooted.join(named, "root").select("node", F.col("best.first").alias("component_id"), F.col("best.node").alias("kept_node")).coalesce(tasks))
    discard_table(nodes)
    stays = (F.col("node") == F.col("kept_node")) & F.col("doc_id").eqNullSafe(F.col("component_id"))
    return rows.select("doc_id", "node").join(named, "node").select("doc_id", "node", "component_id", stays.alias("stays"))


def near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id", bits: int = 3) -> DataFrame:
    """The rows of ``docs`` that stay: one of each component.

    Of several rows with the same id and words the smallest stays.
    """
    groups = durable(components(docs, text, key, bits))  # narrow
    gone = groups.where("NOT stays").select(F.coalesce("doc_id", F.lit(0)).alias("_key"), F.col("doc_id").isNull().alias("_none"), F.col("node").alias("_node")).distinct()
    twice = durable(groups.where("stays").groupBy("doc_id", "node").count().where("count > 1").select("node"))
    rows = docs.select(packed(docs, [text]).alias("_row"), F.col(key).alias("_id"), F.col(text).cast("string").alias("_text"))
    rows = append_columns(rows, ["_text"], [("_text", "string"), ("_node", "long")], lambda found: [pa.array(found, pa.string()), pa.array([node_of(t) for t in found], pa.int64())])
    rows = rows.withColumns({"_key": F.coalesce("_id", F.lit(0)), "_none": F.col("_id").isNull()})
    left = rows.join(gone, ["_key", "_none", "_node"], "left_anti")
    out = [F.col("_text").cast(docs.schema[text].dataType).alias(text) if c == text else F.col("_row").getField(c).alias(c) for c in docs.columns]
    if twice.isEmpty():
        return left.select(*out)
    again = twice.select(F.col("node").alias("_node"))
    one = left.join(again, "_node", "left_semi").groupBy("_key", "_none", "_node").agg(F.min(F.struct("_text", "_row")).alias("_first")).select("_first.*")
    return left.join(again, "_node", "left_anti").select(*out).unionByName(one.select(*out))
