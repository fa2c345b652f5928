"""Exact top-k by inner product: columnar branch-and-bound.

Vectors are dealt into blocks and stored dimension by dimension (vertical
layout), the dimensions in the order of the block's falling energy, with each
vector's mass over the dimensions to come stored once for the block. Queries
meet a block in small groups of like ones (by the signs of their strongest
dimensions), so that a candidate that one of a group wants is one that the
others may want too.

Branch: a group's partial products are accumulated one block of dimensions at
a time. Bound: the candidates that lead after the first are scored in full, and
the k-th best of them, or of what earlier blocks gave, is a floor; after each
block of dimensions a candidate goes if for no query of the group its partial
product and the remaining mass of both sides (Cauchy-Schwarz over the dimensions
to come) reach the floor, and the survivors are compacted. Each meeting returns
at most k rows a query, and ranking keeps k of them before the shuffle.

Every vector is packed once; the query blocks (a stated query set) are dealt
to every group of candidate blocks by an equi-join, so that no task or
broadcast holds all of either side.

Defined cases: vectors that are null, or hold null or non-finite components,
take no part; vectors of unequal length are compared over the shorter one's
dimensions; the zero-length vector scores 0; ties go to the smaller id; rows
with a null id take no part; repeated rows each stand as a candidate and, as
queries, each get an answer of their own; a query never meets its own id; an
empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import durable

#: Vectors to a block, dimensions added between two looks at the bounds, and queries to a group.
BLOCK, STEP, GROUP = 2048, 8, 8
#: Dimensions whose signs order queries, and candidates for each of the k that are scored in full for a floor.
SIGNS, PROBES = 12, 4
#: Candidate blocks that a task holds, about.
HELD = 16


def quantise(values: Column) -> Column:
    """floor(256 x) of every component, as double."""
    return F.transform(values, lambda x: F.floor(x.cast("double") * F.lit(256.0)).cast("double"))


def sound(vector: Column) -> Column:
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) != F.lit(float("inf")))
    return F.coalesce(F.forall(vector, finite), F.lit(False))


def _pack(kind: str) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), BLOCK):
                part = batch.iloc[at : at + BLOCK]
                width = max(map(len, part["vector"]), default=0)
                grid = np.zeros((width, len(part)))
                for i, v in enumerate(part["vector"]):
                    grid[: len(v), i] = v
                ids, rows = part["vec_id"].to_numpy(np.int64), part["row"].to_numpy(np.int64)
                yield pd.DataFrame({"kind": [kind], "block": [int(rows[0])], "width": [width], "ids": [ids.tobytes()], "rows": [rows.tobytes()], "grid": [grid.tobytes()]})

    return pack


#: Query row, candidate's id and score of each hit.
Found = tuple[np.ndarray, np.ndarray, np.ndarray]


class Block:
    """Candidates in vertical layout: dimensions by falling energy, and the mass that remains of each vector after every step of them."""

    def __init__(self, ids: np.ndarray, grid: np.ndarray):
        self.ids, self.order = ids, np.argsort(-np.square(grid).sum(1), kind="stable")
        self.grid = grid[self.order]
        self.rest = masses(self.grid)


def masses(grid: np.ndarray) -> np.ndarray:
    """Of each vector (column) the norm over the dimensions from 0, STEP, 2 STEP ... on; a last row of zeros."""
    steps = -(-len(grid) // STEP)
    squares = np.add.reduceat(np.square(grid), np.arange(0, len(grid), STEP), axis=0) if steps else np.zeros((0, grid.shape[1]))
    tails = np.cumsum(squares[::-1], axis=0)[::-1]
    return np.sqrt(np.vstack((tails, np.zeros((1, grid.shape[1])))))


def like(queries: np.ndarray) -> np.ndarray:
    """The queries (columns) in an order in which like ones stand together: by the signs of their strongest dimensions."""
    strong = np.argsort(-np.square(queries).sum(1), kind="stable")[:SIGNS]
    return np.lexsort((queries[strong] > 0)[::-1]) if len(strong) else np.arange(queries.shape[1])


def search_block(query_ids: np.ndarray, queries: np.ndarray, block: Block, k: int, floor: np.ndarray | None = None, work: list[int] | None = None) -> Found:
    """(query row, id, score) of the k best of one block for each query; queries are dimensions x vectors.

    floor: of each query, a score that k others are known to reach. work: gets
    the products that were computed and those that there are.
    """
    width = len(block.grid)
    asked = np.zeros((width, queries.shape[1]))
    shared = min(width, len(queries))  # the shorter vector's dimensions count
    asked[:shared] = queries[:shared]
    asked = asked[block.order]
    floors = np.full(len(query_ids), -np.inf) if floor is None else floor.copy()
    order, parts = like(asked), []
    for at in range(0, len(order), GROUP):
        group = order[at : at + GROUP]
        parts.append(_search_group(group, query_ids[group], asked[:, group], block, k, floors[group], work))
    q, found, score = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros(0, np.int64),) * 3
    return q, found, score.astype(np.int64)


def _search_group(rows: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, block: Block, k: int, floor: np.ndarray, work: list[int] | None) -> Found:
    width, left, grid = len(block.grid), np.arange(len(block.ids)), block.grid
    scores, rest, done = np.zeros((len(rows), len(left))), masses(queries), 0
    own = query_ids[:, None] == block.ids[None, :]
    scores[own] = -np.inf
    for step, begin in enumerate(range(0, width, STEP)):
        scores += queries[begin : begin + STEP].T @ grid[begin : begin + STEP]
        done += scores.size * min(STEP, width - begin)
        if len(left) <= k or begin + STEP >= width:
            continue
        if step == 0:
            probes = min(len(left), PROBES * k)
            lead = np.argpartition(-scores, probes - 1, axis=1)[:, :probes]
            tried = scores[np.arange(len(rows))[:, None], lead] + np.einsum("dq,dqp->qp", queries[STEP:], grid[STEP:, lead])
            done += tried.size * (width - STEP)
            floor = np.maximum(floor, np.partition(tried, probes - min(k, probes), axis=1)[:, -min(k, probes)] if probes >= k else -np.inf)
        reach = rest[step + 1][:, None] * block.rest[step + 1][left][None, :]
        alive = (scores + reach * (1 + 1e-9) >= floor[:, None]).any(0)
        if not alive.all():
            left, scores, grid = left[alive], scores[:, alive], grid[:, alive]
    if work is not None:
        work[0] += done
        work[1] += len(rows) * len(block.ids) * width
    take = min(k, len(left))
    if not take:
        return (np.zeros(0, np.int64),) * 3
    level = np.partition(scores, len(left) - take, axis=1)[:, -take]
    at, near = np.nonzero((scores >= level[:, None]) & (scores > -np.inf))
    return best_of([(rows[at], block.ids[left[near]], scores[at, near])], k)


def best_of(parts: list[Found], k: int) -> Found:
    """The k best of each query row: highest score, then smallest id."""
    q, found, score = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.lexsort((found, -score, q))
    q, found, score = q[order], found[order], score[order]
    begin = np.flatnonzero(np.append(True, q[1:] != q[:-1])) if len(q) else np.zeros(0, np.int64)
    keep = np.arange(len(q)) - np.repeat(begin, np.diff(np.append(begin, len(q)))) < k
    return q[keep], found[keep], score[keep]


def search_blocks(query_ids: np.ndarray, queries: np.ndarray, blocks: list[Block], k: int, work: list[int] | None = None) -> Found:
    """The same over several blocks; what the first have found bounds the search of the next."""
    nothing = np.zeros(0, np.int64)
    best, floor = (nothing, nothing, nothing), np.full(len(query_ids), -np.inf)
    for block in blocks:
        best = best_of([best, search_block(query_ids, queries, block, k, floor, work)], k)
        count = np.bincount(best[0], minlength=len(query_ids))
        last = np.cumsum(count) - 1
        floor = np.where(count == k, best[2][last] if len(best[2]) else -np.inf, -np.inf)
    return best


def top_k(vectors: DataFrame, is_query: Column, k: int, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """query_id, rank, vec_id and score of each query row's k nearest others by integer inner product of the quantised vectors."""
    rows = vectors.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).alias("v"), is_query.alias("q"))
    rows = rows.where(sound(F.col("v")) & F.col("vec_id").isNotNull()).select("vec_id", F.monotonically_increasing_id().alias("row"), quantise(F.col("v")).alias("vector"), "q")
    schema = "kind string, block long, width int, ids binary, rows binary, grid binary"
    narrow = ["vec_id", "row", "vector"]
    packed = durable(rows.select(*narrow).mapInPandas(_pack("c"), schema).unionAll(rows.where("q").select(*narrow).mapInPandas(_pack("q"), schema)))
    candidates, queries = packed.where("kind = 'c'"), packed.where("kind = 'q'")
    # groups of candidate blocks; every query block goes to each group once
    blocks = candidates.count()
    groups = max(1, min(int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions")), blocks), blocks // HELD)
    columns = ["kind", "width", "ids", "rows", "grid"]
    dealt = candidates.select(F.pmod(F.xxhash64("block"), F.lit(groups)).cast("int").alias("grp"), *columns).unionAll(
        queries.select(F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("grp"), *columns)
    )

    def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows come sorted by group, candidate blocks first; a group's blocks are held while its query blocks pass."""
        held, grp = [], None
        for batch in batches:
            for g, kind, width, ids, number, grid in batch[["grp", "kind", "width", "ids", "rows", "grid"]].itertuples(index=False):
                if g != grp:
                    held, grp = [], g
                names = np.frombuffer(ids, np.int64)
                grid = np.frombuffer(grid, np.float64).reshape(width, len(names))
                if kind == "c":
                    held.append(Block(names, grid))
                    continue
                q, found, score = search_blocks(names, grid, held, k)
                yield pd.DataFrame({"row": np.frombuffer(number, np.int64)[q], "query_id": names[q], "vec_id": found, "score": score})

    local = dealt.repartition(groups, "grp").sortWithinPartitions("grp", "kind").mapInPandas(meet, "row long, query_id long, vec_id long, score long")
    order = Window.partitionBy("row").orderBy(F.col("score").desc(), "vec_id")  # a row, not an id: ids may repeat
    return local.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
