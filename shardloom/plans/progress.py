"""Progress: gap-safe checkpoints, stale and covered tasks, completed months, completion, and indexes to be made."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.naming import month_key

SCOPE = ["table_name", "source_db"]


def checkpoint_prefix(completed: DataFrame, checkpoints: DataFrame, date_from: Column) -> DataFrame:
    """Of each (table_name, source_db): how far completed ranges reach without a gap from the checkpoint on."""
    begun = completed.join(checkpoints.select(*SCOPE, "position"), SCOPE, "left").withColumn("start_at", F.coalesce("position", date_from))
    by_range = Window.partitionBy(*SCOPE).orderBy("range_from", "range_to")
    open_ranges = begun.where(F.col("range_to") > F.col("start_at")).withColumn("expected", F.coalesce(F.lag("range_to").over(by_range), F.col("start_at")))
    gap = F.max((F.col("range_from") != F.col("expected")).cast("int")).over(by_range.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    reach = open_ranges.withColumn("gap", gap).where("gap = 0").groupBy(*SCOPE).agg(F.max("range_to").alias("reach"))
    return begun.groupBy(*SCOPE).agg(F.max("start_at").alias("start_at")).join(reach, SCOPE, "left").select(*SCOPE, F.coalesce("reach", "start_at").alias("position"))


def covered(completed: DataFrame, checkpoints: DataFrame) -> DataFrame:
    """Completed tasks whose whole range a checkpoint has passed: they can go."""
    return completed.alias("t").join(checkpoints.alias("c"), [F.col("t.table_name") == F.col("c.table_name"), F.col("t.source_db") == F.col("c.source_db"), F.col("c.position") >= F.col("t.range_to")], "left_semi")


def stale(tasks: DataFrame, locks: DataFrame) -> DataFrame:
    """Owned tasks without a lock, as they are released."""
    left = tasks.where(F.col("status").isin("RUNNING", "ASSIGNED")).join(locks.select("task_id"), "task_id", "left_anti")
    return left.withColumns({"status": F.lit("AVAILABLE"), "worker_id": F.lit(None).cast("string"), "claim_token": F.lit(None).cast("string")})


def fenced(updates: DataFrame, locks: DataFrame) -> DataFrame:
    """Updates by the present owner: same task, generation and token."""
    return updates.join(locks.select("task_id", "generation", "claim_token"), ["task_id", "generation", "claim_token"], "left_semi")


def crossed_months(moves: DataFrame, before: str, after: str) -> DataFrame:
    """The months from ``before``'s up to, not including, ``after``'s; none from a null or backwards."""
    low, high = F.date_trunc("month", F.col(before)), F.date_trunc("month", F.col(after))
    some = moves.withColumns({"_low": low, "_high": high}).where("_low < _high")
    each = F.sequence(F.col("_low"), F.col("_high") - F.expr("INTERVAL 1 MONTH"), F.expr("INTERVAL 1 MONTH"))
    return some.select("*", F.explode(each).alias("_month")).withColumn("month", month_key(F.col("_month"))).drop("_low", "_high", "_month")


def final_month(date_to: Column) -> Column:
    """The month of the last instant before the end."""
    return month_key(date_to - F.expr("INTERVAL 1 MICROSECOND"))


def complete_months(months: DataFrame, shards: DataFrame, checkpoints: DataFrame) -> DataFrame:
    """(table_name, month) that every expected source shard has passed; ``months`` has month_end."""
    expected = months.crossJoin(shards.select("source_db"))  # configuration, not data
    met = expected.join(checkpoints.select(*SCOPE, "position"), SCOPE, "left")
    return met.groupBy("table_name", "month").agg(F.every(F.coalesce(F.col("position") >= F.col("month_end"), F.lit(False))).alias("done")).where("done").drop("done")


def bulk_complete(tables: DataFrame, shards: DataFrame, checkpoints: DataFrame, date_to: Column) -> DataFrame:
    """One row: whether every enabled table's every source shard has reached the end. True without tables; false without shards or end."""
    pairs = tables.where("enabled").select("table_name").crossJoin(shards.select("source_db")).join(checkpoints.select(*SCOPE, "position"), SCOPE, "left")
    done = pairs.agg(F.every(F.coalesce(F.col("position") >= date_to, F.lit(False))).alias("all_done"))
    counts = shards.agg(F.count("*").alias("n_shards"))
    return done.crossJoin(counts).select((F.coalesce("all_done", F.lit(True)) & (F.col("n_shards") > 0) & date_to.isNotNull()).alias("complete"))


def index_targets(tables: DataFrame, months: DataFrame, new_shards: DataFrame) -> DataFrame:
    """(table_name, month, target_db) to be indexed: plain tables whole (null month), partitioned ones by completed month."""
    whole = tables.where("NOT partitioned").select("table_name", F.lit(None).cast("string").alias("month"))
    parts = months.join(tables.where("partitioned AND index_when_complete").select("table_name"), "table_name", "left_semi").select("table_name", "month")
    return whole.unionByName(parts).crossJoin(new_shards.select("target_db"))


def verify_ready(moved: DataFrame, partitioned: bool, statuses: DataFrame, new_shards: list[str]) -> DataFrame:
    """Adds verify_ready to moved rows (target_db, table_name, month): on old shards always; on new ones once indexed, for partitioned tables."""
    fresh = F.col("target_db").isin(*new_shards) if new_shards else F.lit(False)
    if not partitioned:
        return moved.withColumn("verify_ready", F.lit(True))
    made = statuses.where("status = 'CREATED'").select("table_name", "target_db", "month", F.lit(True).alias("_made")).distinct()
    return moved.join(made, ["table_name", "target_db", "month"], "left").withColumn("verify_ready", ~fresh | F.coalesce("_made", F.lit(False))).drop("_made")


def all_index_targets(tables: DataFrame, new_shards: DataFrame) -> DataFrame:
    """Every table on every new shard."""
    return tables.select("table_name").crossJoin(new_shards.select("target_db"))


def index_status(statements: DataFrame, failed: DataFrame) -> DataFrame:
    """Of each (table_name, target_db, month): the indexes' names, and CREATED or, if any of them failed, FAILED."""
    tried = statements.join(failed.select("target_db", "index_name", F.lit(True).alias("_failed")).distinct(), ["target_db", "index_name"], "left")
    state = F.when(F.bool_or(F.coalesce("_failed", F.lit(False))), "FAILED").otherwise("CREATED")
    return tried.groupBy("table_name", "target_db", "month").agg(F.sort_array(F.collect_set("index_name")).alias("index_names"), state.alias("status"))


def completed_scopes(tasks: DataFrame) -> DataFrame:
    """Of each (table_name, source_db): completed ranges, the last one's end, and the highest sequence number."""
    done = tasks.where("status = 'COMPLETED'")
    return done.groupBy(*SCOPE).agg(F.count("*").alias("n_ranges"), F.max("range_to").alias("last_to"), F.max("sequence_number").alias("last_sequence"))


def apply_events(tasks: DataFrame, events: DataFrame, locks: DataFrame) -> DataFrame:
    """Tasks after events (task_id, generation, claim_token, event) by their owners; others' events change nothing."""
    from .state import task_after

    mine = fenced(events, locks).select("task_id", "event")
    met = tasks.join(mine, "task_id", "left")
    return met.withColumn("status", F.when(F.col("event").isNull(), F.col("status")).otherwise(task_after(F.col("event"), F.col("status")))).drop("event")
