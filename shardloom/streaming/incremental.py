"""Rows that arrive after the bulk move: a file stream, routed and committed batch by batch through the ledger."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..operators.ledger import commit, ledger_key, transferred
from ..operators.routing import moved, route
from ..spec import TableSpec, Topology

__all__ = ["arrivals", "caught_up", "run", "transferred"]


def arrivals(spark: SparkSession, path: str, schema: StructType, since: Column | None = None, files: int = 1000, glob: str = "*") -> DataFrame:
    """A stream of a folder's files, a bounded number of them in each batch."""
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).option("pathGlobFilter", glob).parquet(path)
    return rows if since is None else rows.where(since)


def run(stream: DataFrame, move: str, table: TableSpec, current: Topology, target: Topology, data: str, ledger: str, checkpoint: str, order: Sequence[Column], every: str | None = None, name: str = "stream") -> StreamingQuery:
    """Start moving a stream's rows. The stream's checkpoint is the cursor; the ledger keeps out what was moved before.

    Without ``every`` it stops when it has caught up. ``name`` tells the move's
    streams apart: each has a checkpoint and batches of its own.
    """

    def take(batch: DataFrame, batch_id: int) -> None:
        routed = moved(route(batch, table, current, target)).withColumns(ledger_key(move, table.table))
        commit(routed, batch_id, data, ledger, table.id_column, order, f"{move}.{name}")

    writer = stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def caught_up(query: StreamingQuery) -> bool:
    last = query.lastProgress
    return query.exception() is None and (not query.isActive or (last is not None and last["numInputRows"] == 0))
