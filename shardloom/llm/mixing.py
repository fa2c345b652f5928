"""Mixing sources to target weights, by budgets handed down a tree.

A node's budget goes to its children by weight, but no child gets more than
its supply (tokens times the most epochs). What a child can't use goes to its
siblings; only what a whole family can't use goes to the family's own
siblings, because a family's supply is its children's. A leaf with budget for
several epochs takes whole ones, and of the last the prefix of a seeded order:
documents, in the order of their MD5 with the seed and the epoch, as long as
their tokens fit.

Trees of up to ``MOST_LEAVES`` leaves are planned on the driver; larger ones, as
with hosts for sources, by grouped aggregations level by level, to the same
budgets: in each round every family's open children that can't use their share
are closed at their supply, until none is.

The prefix is found without sorting a leaf: tokens are summed by leaf and by
hash range, the running sums over the ranges give the range where the budget
ends, and only that range's documents are ordered. The result is a filter on
the documents; texts are not shuffled.

Defined cases: a null level is a value of its own; a null text has no tokens
and belongs to any prefix its hash is in (a leaf without any tokens is taken
once); rows of one id stand or fall
together; children without a stated weight have the weight 1; weights must
not be negative; an empty table gives an empty result; a column named
``epoch`` is replaced, others pass through.
"""

from __future__ import annotations

import math
from collections.abc import Mapping
from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WORD, durable, packed, unpacked

#: Hexadecimal digits that name a hash range: 4,096 ranges to a leaf.
RANGE_DIGITS = 3
#: Leaves that the driver plans and sends to every executor; more are planned and joined by shuffles.
MOST_LEAVES = 100_000

Path = tuple


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def share(budget: int, weights: Mapping, supply: Mapping) -> dict:
    """What each child gets: by weight, no more than its supply, what is left over going to the others by weight."""
    got: dict = {}
    left, open_ = Fraction(budget), {c for c in supply if weights.get(c, 1) > 0}
    while open_:
        total = sum(Fraction(weights.get(c, 1)) for c in open_)
        part = {c: left * Fraction(weights.get(c, 1)) / total for c in open_}
        full = {c for c in open_ if part[c] >= supply[c]}
        if not full:
            break
        for c in full:
            got[c] = supply[c]
            left -= supply[c]
        open_ -= full
    got |= {c: part[c] for c in open_}
    return {c: int(got.get(c, 0)) for c in supply}


def budgets(total: int, tokens: Mapping[Path, int], weights: Mapping[Path, float], epochs: int) -> dict[Path, int]:
    """Each leaf's budget. tokens: of each leaf, by its path; weights: of a node among its siblings, by its path."""

    def down(budget: int, leaves: list[Path], depth: int) -> dict[Path, int]:
        if not leaves or len(leaves[0]) == depth:
            return {leaf: budget for leaf in leaves}
        families: dict[Path, list[Path]] = {}
        for leaf in leaves:
            families.setdefault(leaf[: depth + 1], []).append(leaf)
        got = share(budget, weights, {f: epochs * sum(tokens[x] for x in own) for f, own in families.items()})
        out: dict[Path, int] = {}
        for family, own in families.items():
            out |= down(got[family], own, depth + 1)
        return out

    return down(total, sorted(tokens, key=repr), 0)


def _meet(left: DataFrame, right: DataFrame, names: list[str], how: str = "inner") -> DataFrame:
    """The left rows with the other columns of the right row of the same names, nulls included."""
    other = right.select(*[F.col(n).alias(f"{n}_") for n in names], *[c for c in right.columns if c not in names])
    met = left.join(other, [F.col(n).eqNullSafe(F.col(f"{n}_")) for n in names], how) if names else left.crossJoin(other)  # without names the right has one row
    return met.drop(*[f"{n}_" for n in names])


def budgets_by_level(leaves: DataFrame, names: list[str], total: int, weights: Mapping[Path, float], epochs: int) -> DataFrame:
    """The same as ``budgets`` for leaves (``names``, tokens) in any number: each with its budget."""
    big = "decimal(38,0)"
    scale = math.lcm(*[Fraction(w).denominator for w in weights.values()]) if weights else 1
    above: DataFrame | None = None
    for depth in range(1, len(names) + 1):
        own, family = names[:depth], names[: depth - 1]
        nodes = leaves.groupBy(*own).agg((F.sum("tokens").cast(big) * epochs).cast(big).alias("supply"))
        stated = [(*path, int(Fraction(w) * scale)) for path, w in weights.items() if len(path) == depth]
        table = leaves.sparkSession.createDataFrame(stated, T.StructType([T.StructField(n, T.StringType()) for n in own]).add("weight", "long"))
        nodes = _meet(nodes, F.broadcast(table), own, "left").withColumn("weight", F.coalesce("weight", F.lit(scale)).cast(big))
        if above is None:
            nodes = nodes.withColumn("given", F.lit(total).cast(big))
        else:
            nodes = _meet(nodes, above.withColumnRenamed("budget", "given"), family)
        nodes = durable(nodes.withColumn("closed", F.col("weight") <= 0).withColumn("got", F.lit(0).cast(big)))
        while True:
            state = nodes.groupBy(*family).agg((F.first("given") - F.sum("got")).cast(big).alias("left"), F.sum(F.when(~F.col("closed"), F.col("weight")).otherwise(0)).cast(big).alias("open"))
            met = durable(_meet(nodes, state, family).withColumn("full", ~F.col("closed") & F.expr("left * weight >= supply * open")))
            if met.where("full").isEmpty():
                above = met.select(*own, F.when(F.col("closed"), F.col("got")).otherwise(F.expr("(left * weight) div open")).cast(big).alias("budget"))
                break
            nodes = met.select(*own, "supply", "weight", "given", (F.col("closed") | F.col("full")).alias("closed"), F.when(F.col("full"), F.col("supply")).otherwise(F.col("got")).alias("got"))
    return above.withColumn("budget", F.col("budget").cast("long"))


def mix(docs: DataFrame, levels: Mapping[str, Column], weights: Mapping[Path, float], fraction: float = 1.0, epochs: int = 4, seed: int = 0, tokens: Column | None = None, key: str = "doc_id") -> DataFrame:
    """The chosen rows of ``docs``, once for each epoch they are in, with the column epoch.

    levels: the tree's levels from the root, each a value of a document;
    fraction: the budget as a part of all tokens; epochs: the most a leaf gives.
    """
    spark, names = docs.sparkSession, [f"_level{i}" for i in range(len(levels))]
    value = [c.cast("string").alias(n) for n, c in zip(names, levels.values(), strict=True)]
    count = tokens if tokens is not None else n_words(F.col("text"))
    rows = durable(docs.select(F.col(key).alias("_key"), *value, count.alias("_tokens")))  # narrow: read three times
    held = durable(rows.groupBy(*names).agg(F.sum("_tokens").alias("tokens")))
    leaves = held.limit(MOST_LEAVES + 1).collect()
    few = len(leaves) <= MOST_LEAVES
    sent = F.broadcast if few else lambda df: df  # what has one row a leaf
    if few:
        supply = {tuple(r[n] for n in names): r["tokens"] for r in leaves}
        plan = budgets(int(Fraction(str(fraction)) * sum(supply.values())), supply, weights, epochs)
        table = [(*leaf, *(divmod(plan[leaf], n) if (n := supply[leaf]) else (1, 0))) for leaf in plan]
        schema = T.StructType([T.StructField(n, T.StringType()) for n in names]).add("_whole", "long").add("_rest", "long")
        leaf = F.broadcast(spark.createDataFrame(table, schema))
    else:
        total = held.agg(F.sum("tokens")).first()[0] or 0
        planned = budgets_by_level(held, names, int(Fraction(str(fraction)) * total), weights, epochs)
        met = _meet(held, planned, names)
        some = F.col("tokens") > 0
        leaf = durable(met.select(*names, F.when(some, F.expr("budget div tokens")).otherwise(1).alias("_whole"), F.when(some, F.col("budget") % F.col("tokens")).otherwise(0).alias("_rest")))

    def at_leaf(df: DataFrame, other: DataFrame) -> DataFrame:
        met = [df[n].eqNullSafe(other[n]) for n in names]
        return df.join(other, met).drop(*[other[n] for n in names])

    def place(df: DataFrame, k: str) -> DataFrame:
        order = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("_whole").cast("string"), F.col(k).cast("string")))
        return df.withColumn("_order", order).withColumn("_range", F.substring("_order", 1, RANGE_DIGITS))

    placed = place(at_leaf(rows, leaf), "_key")
    running = Window.partitionBy(*names).orderBy("_range").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = placed.groupBy(*names, "_range", "_rest").agg(F.sum("_tokens").alias("n")).withColumn("upto", F.sum("n").over(running))
    # the range in which the budget ends, and what is left for it; a row a leaf
    cut = durable(sums.where("upto > _rest").groupBy(*names).agg(F.min(F.struct("_range", (F.col("_rest") - F.col("upto") + F.col("n")).alias("left"))).alias("cut")).select(*names, F.col("cut._range").alias("_cut"), F.col("cut.left").alias("_left")))
    edge = at_leaf(placed, sent(cut)).where("_range = _cut")
    within = Window.partitionBy(*names).orderBy("_order", "_key")  # rows of one id are peers
    fits = edge.withColumn("upto", F.sum("_tokens").over(within)).where("upto <= _left")
    last = fits.groupBy(*names).agg(F.max(F.struct("_order", "_key")).alias("_last"))
    ends = durable(cut.alias("c").join(last.alias("l"), [F.col(f"c.{n}").eqNullSafe(F.col(f"l.{n}")) for n in names], "left").select(*[F.col(f"c.{n}").alias(n) for n in names], "_cut", "_last"))

    whole = docs.select(packed(docs, ["epoch"]).alias("_row"), F.col(key).alias("_key"), *value)
    whole = place(at_leaf(whole, leaf), "_key")
    met = [whole[n].eqNullSafe(ends[n]) for n in names]
    whole = whole.join(sent(ends), met, "left")
    mine = F.struct("_order", F.col("_key"))
    inside = F.col("_cut").isNull() | (F.col("_range") < F.col("_cut")) | ((F.col("_range") == F.col("_cut")) & F.coalesce(mine <= F.col("_last"), F.lit(False)))
    times = F.col("_whole").cast("int") + F.when(inside & (F.col("_rest") > 0), 1).otherwise(0)
    return whole.withColumn("_times", times).where("_times > 0").select(*unpacked("_row", docs, ["epoch"]), F.explode(F.sequence(F.lit(0), F.col("_times") - 1)).alias("epoch"))
