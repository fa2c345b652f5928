"""Beyond the reference, which names these but has no code for them: checks of a move, removal at the source, ranges by key, target slots."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def verify(expected: DataFrame, found: DataFrame, key: str = "key_value") -> DataFrame:
    """Of each target shard: keys expected and found, missing and unexpected."""
    a = expected.select("target_db", F.col(key).alias("k")).distinct().withColumn("_e", F.lit(1))
    b = found.select("target_db", F.col(key).alias("k")).distinct().withColumn("_f", F.lit(1))
    met = a.join(b, ["target_db", "k"], "full_outer")
    return met.groupBy("target_db").agg(
        F.count("_e").alias("n_expected"), F.count("_f").alias("n_found"), F.count_if(F.col("_f").isNull()).alias("n_missing"), F.count_if(F.col("_e").isNull()).alias("n_unexpected")
    )


def left_at_source(rows: DataFrame, ledger: DataFrame, key: str = "key_value") -> DataFrame:
    """A source's rows without those whose key was moved."""
    return rows.join(ledger.select(F.col("shard_key_value").alias(key)), key, "left_anti")


def key_ranges(rows: DataFrame, key: str, width: int) -> DataFrame:
    """Half-open ranges of a numeric key that hold rows, and how many."""
    low = F.floor(F.col(key) / width) * width
    return rows.where(F.col(key).isNotNull()).groupBy(low.cast("long").alias("from_id")).agg(F.count("*").alias("n_rows")).withColumn("to_id", F.col("from_id") + F.lit(width).cast("long"))


def target_slots(pairs: DataFrame, limits: DataFrame) -> DataFrame:
    """Numbered slots of each target database for (task_id, target_db, sequence_number), up to its limit."""
    at = F.row_number().over(Window.partitionBy("target_db").orderBy("sequence_number", "task_id"))
    held = pairs.withColumn("_n", at).join(limits.select(F.col("source_db").alias("target_db"), F.col("max_source").alias("_most")), "target_db").where("_n <= _most")
    return held.select("target_db", F.format_string("%03d", F.col("_n")).alias("slot"), "task_id")
