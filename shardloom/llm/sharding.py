"""Sharding by jump consistent hashing, in DataFrame functions only.

``jump_shard(key, n)`` is a Column: the shard of a 64-bit key among ``n``,
with no table of ring points. Going from n to n + 1 shards moves a key only
into the new shard, and about 1 / (n + 1) of the keys.

``assign`` adds each row's place in its shard. Rows are dealt by a range
partitioning on (shard, key, ...), so that equal keys or texts don't meet in
one task; the per-partition counts, of which there are at most partitions +
shards, give each partition's first slot.

Defined cases: a null key counts as 0; a null text has no bytes (CRC 0, size
1); an empty table gives an empty result; repeated rows have slots of their
own; only the named columns are read, so extra columns can have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import durable

#: The multiplier of the published algorithm's 64-bit linear congruential step (fixed value).
JUMP_MULTIPLIER = 2862933555777941757

_MASK32 = 0xFFFFFFFF


def _step(hi: Column, lo: Column) -> tuple[Column, Column]:
    """(hi, lo) * JUMP_MULTIPLIER + 1 modulo 2**64 in 32-bit halves; no product overflows a long."""
    m_hi, m_lo = JUMP_MULTIPLIER >> 32, JUMP_MULTIPLIER & _MASK32

    def low32(a: Column, m: int) -> Column:
        upper = F.shiftleft((F.shiftright(a, 16) * F.lit(m)).bitwiseAND(F.lit(0xFFFF)), 16)
        return ((a.bitwiseAND(F.lit(0xFFFF)) * F.lit(m)).bitwiseAND(F.lit(_MASK32)) + upper).bitwiseAND(F.lit(_MASK32))

    t0 = lo.bitwiseAND(F.lit(0xFFFF)) * F.lit(m_lo)
    t1 = F.shiftright(lo, 16) * F.lit(m_lo)
    total = t0.bitwiseAND(F.lit(_MASK32)) + F.shiftleft(t1.bitwiseAND(F.lit(0xFFFF)), 16) + F.lit(1)
    carry = F.shiftright(t0, 32) + F.shiftright(t1, 16) + F.shiftright(total, 32)
    return (carry + low32(lo, m_hi) + low32(hi, m_lo)).bitwiseAND(F.lit(_MASK32)), total.bitwiseAND(F.lit(_MASK32))


def jump_shard(key: Column, shards: int) -> Column:
    """The shard, from 0, of a long key (taken as unsigned 64 bits; null as 0) among ``shards``."""
    if shards < 1:
        raise ValueError("shards must be at least 1")
    k = F.coalesce(key.cast("long"), F.lit(0).cast("long"))
    zero = F.struct(
        F.shiftrightunsigned(k, 32).alias("hi"), k.bitwiseAND(F.lit(_MASK32)).alias("lo"), F.lit(-1).cast("long").alias("b"), F.lit(0).cast("long").alias("j")
    )

    def advance(s: Column, _: Column) -> Column:
        hi, lo = _step(s["hi"], s["lo"])
        jump = ((s["j"] + 1).cast("double") * (F.lit(2147483648.0) / (F.shiftright(hi, 1) + 1).cast("double"))).cast("long")
        after = F.struct(hi.alias("hi"), lo.alias("lo"), s["j"].alias("b"), jump.alias("j"))
        return F.when(s["j"] < F.lit(shards), after).otherwise(s)

    # each step raises b, so that after ``shards`` of them j is past the last shard
    return F.aggregate(F.sequence(F.lit(1), F.lit(shards)), zero, advance, lambda s: s["b"].cast("int"))


def assign(docs: DataFrame, shards: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Of each row: the key, size, text_crc32, law, shard, slot (gapless from 0 in each shard) and grown_shard."""
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.select(
        F.col(key).alias("doc_id"),
        (F.octet_length(body) + 1).cast("long").alias("size"),
        F.crc32(F.encode(body, "UTF-8")).alias("text_crc32"),
        jump_shard(F.col(key), shards).alias("shard"),
        jump_shard(F.col(key), shards + 1).alias("grown_shard"),
        F.monotonically_increasing_id().alias("_row"),
    )
    order = ["shard", "doc_id", "text_crc32", "size", "_row"]
    # written before it is numbered: a range partitioning sampled anew would deal otherwise
    dealt = durable(rows.repartitionByRange(*order).sortWithinPartitions(*order).drop("_row"))
    dealt = dealt.select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("_at"))
    parts = dealt.groupBy("shard", "_part").agg(F.count("*").alias("n"), F.min("_at").alias("_from"))
    before = Window.partitionBy("shard").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    firsts = parts.select("shard", "_part", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("_from")).alias("_first"))
    # one row for each partition and for each shard's first: bounded by the plan, not by the data
    return dealt.join(F.broadcast(firsts), ["shard", "_part"]).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("_first") + F.col("_at")).alias("slot"), "grown_shard"
    )
