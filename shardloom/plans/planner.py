"""Range planning over tables and source shards, capacity, batch sizes and slots, as DataFrames of plan rows.

Plan tables are as small as the configuration and the move's span; none grows with the rows that are moved.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.naming import task_id

OWNED = ("RUNNING", "ASSIGNED")
CLAIMABLE = ("CREATED", "AVAILABLE")


def slices(scopes: DataFrame, start: str, end: str, minutes: int) -> DataFrame:
    """Every slice [range_from, range_to) of each scope from its ``start`` up to ``end``, the last one cut off there."""
    step = F.expr(f"INTERVAL {int(minutes)} MINUTE")
    some = scopes.where(F.col(start) < F.col(end))  # a sequence can't run backwards
    cut = some.withColumn("range_from", F.explode(F.sequence(F.col(start), F.col(end), step))).where(F.col("range_from") < F.col(end))
    return cut.withColumn("range_to", F.least(F.col("range_from") + step, F.col(end)))


def next_start(scopes: DataFrame, checkpoints: DataFrame, tasks: DataFrame, date_from: Column) -> DataFrame:
    """Of each (table_name, source_db): where its next range begins, past the checkpoint and all known tasks."""
    scope = ["table_name", "source_db"]
    known = tasks.groupBy(*scope).agg(F.max("range_to").alias("in_flight"))
    met = scopes.join(checkpoints.select(*scope, "position"), scope, "left").join(known, scope, "left")
    return met.withColumn("next_from", F.greatest(date_from, F.coalesce("position", date_from), F.coalesce("in_flight", date_from))).drop("position", "in_flight")


def last_sequence(tasks: DataFrame) -> int:
    return tasks.agg(F.coalesce(F.max("sequence_number"), F.lit(0))).first()[0]


def plan_next(starts: DataFrame, date_to: Column, minutes: int, free: int, after: int, order: list[str]) -> DataFrame:
    """At most one new task for each scope, in order, as many as there are free places, numbered on from ``after``."""
    ready = starts.where(F.col("next_from") < date_to)
    rank = F.row_number().over(Window.orderBy(*order))  # a row for each table and shard
    chosen = ready.withColumn("sequence_number", rank + F.lit(after)).where(F.col("sequence_number") <= F.lit(after + max(0, free)))
    upto = F.least(F.col("next_from") + F.expr(f"INTERVAL {int(minutes)} MINUTE"), date_to)
    return chosen.select(
        task_id(F.col("table_name"), F.col("source_db"), F.col("next_from")).alias("task_id"), "table_name", "source_db", F.col("next_from").alias("range_from"), upto.alias("range_to"), F.lit("CREATED").alias("status"), F.lit(0).cast("long").alias("generation"), "sequence_number"
    )


def running() -> Column:
    return F.count_if(F.col("status").isin(*OWNED))


def active(tasks: DataFrame) -> DataFrame:
    return tasks.where(F.col("status") != "COMPLETED")


def free_places(workers: Column, concurrent: Column, busy: Column) -> Column:
    return F.greatest(F.lit(0), F.least(workers, concurrent) - busy)


def batch_sizes(tasks: DataFrame, copy: int, idempotent: int, divisor: int, current: Column, check: Column) -> DataFrame:
    """Adds idempotent, active_source, read_size, write_size and insert_mode. A reclaimed task inserts idempotently."""
    careful = check | (F.col("generation") > 1)
    active_source = F.array_contains(current, F.col("source_db"))
    whole = F.when(F.col("batch_size") > 0, F.col("batch_size")).otherwise(F.lit(copy)).cast("long")
    reduced = F.greatest(F.lit(1).cast("long"), F.floor(whole / divisor).cast("long"))
    return tasks.withColumns({
        "idempotent": careful, "active_source": active_source,
        "read_size": F.when(careful, F.lit(idempotent).cast("long")).when(active_source, reduced).otherwise(whole),
        "write_size": F.when(careful, F.lit(idempotent).cast("long")).otherwise(whole),
        "insert_mode": F.when(careful, "IDEMPOTENT_INSERT").otherwise("COPY"),
    })


def target_sizes(sized: DataFrame, divisor: int, current: Column, target: Column) -> DataFrame:
    """The sizes for one target shard: a new shard takes whole copies, a live one smaller row inserts."""
    fresh = F.array_contains(target, F.col("target_db")) & ~F.array_contains(current, F.col("target_db"))
    keep = (F.col("insert_mode") == "IDEMPOTENT_INSERT") | fresh
    smaller = F.greatest(F.lit(1).cast("long"), F.floor(F.col("write_size") / divisor).cast("long"))
    return sized.withColumns({"write_size": F.when(keep, F.col("write_size")).otherwise(smaller), "insert_mode": F.when(keep, F.col("insert_mode")).otherwise("ROW_INSERT")})


def assign_slots(tasks: DataFrame, limits: DataFrame) -> DataFrame:
    """Numbered slots of each source database, in task order, up to its limit."""
    at = F.row_number().over(Window.partitionBy("source_db").orderBy("sequence_number", "task_id"))
    held = tasks.withColumn("_n", at).join(limits, "source_db").where(F.col("_n") <= F.col("max_source"))
    return held.withColumn("slot", F.format_string("%03d", F.col("_n"))).drop("_n", "max_source")


def orphan_slots(slots: DataFrame, tasks: DataFrame) -> DataFrame:
    """Slots held for a task that isn't active any more."""
    return slots.join(active(tasks).select("task_id"), "task_id", "left_anti")


def claim_next(tasks: DataFrame, most: int = 1) -> DataFrame:
    """The tasks to be claimed first, as their claim leaves them; the claimer adds its token."""
    first = tasks.where(F.col("status").isin(*CLAIMABLE)).orderBy("sequence_number", "task_id").limit(most)
    return first.withColumns({"generation": F.col("generation") + 1, "status": F.lit("ASSIGNED")})
