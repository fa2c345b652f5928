"""From a row to its shards: the key by rule, the source and target shard, and what has to move."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import BUCKET_BITS, key_hash, modulo_shard, segments
from ..spec import HASH_MOD, ShardKey, TableSpec, Topology


def _choose(key: ShardKey, result) -> Column:
    if key.field:
        return result(key.field)
    out = None
    for rule in key.rules:  # the first that fits wins; a null never fits
        fits = F.col(rule.when).cast("string") == rule.value
        out = F.when(fits, result(rule.use)) if out is None else out.when(fits, result(rule.use))
    return result(key.default) if out is None else out.otherwise(result(key.default))


def key_field(key: ShardKey) -> Column:
    """The name of the column that a row's key comes from."""
    return _choose(key, F.lit)


def key_text(key: ShardKey) -> Column:
    """A row's key as text; keys are hashed and compared as text."""
    return _choose(key, lambda c: F.col(c).cast("string"))


def present(key: Column) -> Column:
    """The key; a null one fails the job, because no shard would be right."""
    return F.coalesce(key, F.raise_error(F.lit("Shard key is null")).cast("string"))


def on_ring(df: DataFrame, hash_column: str, topology: Topology, out: str) -> DataFrame:
    """Adds the shard of a hash.

    The ring becomes segments without gaps, cut at bucket borders, so that the
    lookup is a hash join on the bucket with a range check: the broadcast side
    has points + 2 ** BUCKET_BITS rows at most, whatever the data's size.
    """
    table = df.sparkSession.createDataFrame(list(segments(topology)), "_bucket long, _low long, _high long, _shard string")
    h = F.col(hash_column)
    met = (F.shiftright(h, 32 - BUCKET_BITS) == F.col("_bucket")) & (h >= F.col("_low")) & (h <= F.col("_high"))
    return df.join(F.broadcast(table), met, "left").drop("_bucket", "_low", "_high").withColumnRenamed("_shard", out)


def to_shard(df: DataFrame, key_column: str, topology: Topology, algorithm: str, out: str) -> DataFrame:
    if algorithm == HASH_MOD:
        return df.withColumn(out, modulo_shard(F.col(key_column), topology.ids))
    return on_ring(df.withColumn("_hash", key_hash(F.col(key_column))), "_hash", topology, out).drop("_hash")


def route(df: DataFrame, table: TableSpec, current: Topology, target: Topology) -> DataFrame:
    """Adds key_field, key_value, source_db and target_db."""
    keyed = df.withColumns({"key_field": key_field(table.shard_key), "key_value": present(key_text(table.shard_key))})
    return to_shard(to_shard(keyed, "key_value", current, table.algorithm, "source_db"), "key_value", target, table.algorithm, "target_db")


def moved(routed: DataFrame) -> DataFrame:
    return routed.where(F.col("source_db") != F.col("target_db"))


def new_shards(current: Column, target: Column) -> Column:
    """The target's shards that are not current ones, as listed."""
    return F.filter(target, lambda x: ~F.array_contains(current, x))
