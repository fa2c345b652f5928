"""Once-only transfer: the ledger of moved keys, first-wins, and commits that can be repeated."""

from __future__ import annotations

from collections.abc import Sequence
from threading import Lock
from urllib.parse import quote, unquote

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

LEDGER = "migration_id string, source_table string, shard_key_field string, shard_key_value string, transferred_at timestamp, writer string, batch_id long"
KEY = ["migration_id", "source_table", "shard_key_field", "shard_key_value"]

#: An empty file beside a batch's ledger entries: the batch took effect.
MARK = "_committed"
#: Keys of a batch that are sent to every executor, so that the ledger stays where it is.
MOST_BROADCAST = 500_000
_turns: dict[str, Lock] = {}


def ledger_key(move: str, table: str) -> dict[str, Column]:
    """The key's four parts, from a routed row: two fields never clash, a number and its text do."""
    return {"migration_id": F.lit(move), "source_table": F.lit(table), "shard_key_field": F.col("key_field"), "shard_key_value": F.col("key_value")}


def first_wins(df: DataFrame, key: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row a key: the first in a total order. Each task passes on one row a key at most, so a hot key costs little."""
    first = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    return df.withColumn("_rank", first).where("_rank = 1").drop("_rank")


def not_in_ledger(df: DataFrame, ledger: DataFrame) -> DataFrame:
    return df.join(ledger.select(*KEY), KEY, "left_anti")


def touched(ledger: DataFrame, keys: DataFrame) -> DataFrame:
    """The ledger's entries that a batch can meet. Where the batch's keys are few, they go to the ledger, which is then not shuffled."""
    few = keys.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST
    return ledger.join(F.broadcast(keys.select(*KEY)), KEY, "left_semi") if few else ledger


def insert_rows(df: DataFrame, id_column: str) -> DataFrame:
    """What is inserted: all columns but the id, whose name is compared with its case."""
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c != id_column])


def _folder(path: str, writer: str, batch_id: int) -> str:
    return f"{path}/writer={quote(writer, safe='')}/batch_id={batch_id}"


def _files(spark: SparkSession, path: str) -> tuple:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def ensure_ledger(spark: SparkSession, path: str) -> DataFrame:
    """The ledger at a path, empty if there is none yet."""
    at, files = _files(spark, path)
    files.mkdirs(at)
    return spark.read.schema(LEDGER).parquet(path)


def committed(spark: SparkSession, ledger_path: str) -> DataFrame:
    """(writer, batch_id) of every batch that took effect: those with a mark. A row a batch, read from file names alone."""
    at, files = _files(spark, f"{ledger_path}/writer=*/batch_id=*/{MARK}")
    found = [f.getPath().getParent() for f in files.globStatus(at) or ()]
    rows = [(unquote(p.getParent().getName().partition("=")[2]), int(p.getName().partition("=")[2])) for p in found]
    return F.broadcast(spark.createDataFrame(rows, "writer string, batch_id long"))


def commit(rows: DataFrame, batch_id: int, data_path: str, ledger_path: str, id_column: str, order: Sequence[Column], writer: str = "only") -> None:
    """Write a batch's new rows by target shard, then their ledger entries, then the batch's mark, by which it takes effect.

    A batch is named by its writer and number: a move's task, a stream. It
    replaces what an earlier try of the same batch left and nothing else, and
    what other writers or batches have committed counts against it. It is
    therefore whole or repeatable, whenever it broke off. Writers of one ledger
    take turns within an application; two applications must not share one.
    """
    spark = rows.sparkSession
    with _turns.setdefault(ledger_path, Lock()):
        mine = (F.col("writer") == writer) & (F.col("batch_id") == batch_id)
        earlier = ensure_ledger(spark, ledger_path).where(~mine).join(committed(spark, ledger_path), ["writer", "batch_id"], "left_semi")
        first = first_wins(rows, KEY, order).persist()  # of a key only its first row can be new
        try:
            inserted = insert_rows(not_in_ledger(first, touched(earlier, first)), id_column)
            data, book = _folder(data_path, writer, batch_id), _folder(ledger_path, writer, batch_id)
            inserted.write.mode("overwrite").partitionBy("target_db").parquet(data)
        finally:
            first.unpersist()
        written = spark.read.schema(inserted.schema).parquet(data).select(*KEY)  # may be no row
        written.withColumn("transferred_at", F.current_timestamp()).write.mode("overwrite").parquet(book)
        at, files = _files(spark, f"{book}/{MARK}")
        files.create(at, True).close()


def transferred(spark: SparkSession, data: str, ledger: str, schema: StructType | None = None) -> DataFrame:
    """The rows of batches that took effect. ``schema``: of the rows, where there may be none yet."""
    found = spark.read if schema is None else spark.read.schema(StructType([*schema, *StructType.fromDDL("writer string, batch_id long")]))
    return found.parquet(data).join(committed(spark, ledger), ["writer", "batch_id"], "left_semi")
