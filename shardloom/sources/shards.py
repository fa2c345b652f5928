"""Where a shard's rows come from and go to: JDBC databases or files by shard."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from datetime import datetime
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions.naming import IDENTIFIER
from ..operators.ledger import KEY
from ..spec import Shard
from .workspace import workspace

#: The ledger of a target database, by which a key is inserted once.
LEDGER_TABLE = "migration_row_ledger"
_LEDGER_DDL = f'CREATE TABLE "{LEDGER_TABLE}" (' + ", ".join(f'"{c}" VARCHAR(250) NOT NULL' for c in KEY) + f', "batch_id" VARCHAR(250) NOT NULL, PRIMARY KEY ({", ".join(chr(34) + c + chr(34) for c in KEY)}))'


def quoted(name: str) -> str:
    """A valid identifier, or several joined by dots, in double quotes; any other is an error."""
    parts = name.split(".")
    if not all(re.match(IDENTIFIER, p) for p in parts):
        raise ValueError(f"unsafe SQL identifier: {name}")
    return ".".join(f'"{p}"' for p in parts)


def read_jdbc(spark: SparkSession, shard: Shard, table: str, time: str, slices: Sequence[tuple[datetime, datetime]], fetch: int = 5000, **options: str) -> DataFrame:
    """A shard's table, a partition for each half-open time slice; the database filters each by its index."""
    at = quoted(time)
    where = [f"{at} >= {{ts '{a:%Y-%m-%d %H:%M:%S.%f}'}} AND {at} < {{ts '{b:%Y-%m-%d %H:%M:%S.%f}'}}" for a, b in slices]  # JDBC's own form of a time
    return spark.read.jdbc(shard.url, quoted(table), predicates=where, properties={"fetchsize": str(fetch)} | options).withColumn("source_db", F.lit(shard.id))


@contextmanager
def _connected(spark: SparkSession, url: str) -> Iterator:
    """A connection of the driver's JVM: statements only, no rows pass through it."""
    connection = spark._jvm.java.sql.DriverManager.getConnection(url)
    try:
        yield connection
    finally:
        connection.close()


def execute(spark: SparkSession, url: str, statements: Sequence[str]) -> list[int]:
    """Run statements as one transaction; how many rows each changed."""
    with _connected(spark, url) as connection:
        connection.setAutoCommit(False)
        try:
            counts = [connection.createStatement().executeUpdate(s) for s in statements]
            connection.commit()
            return counts
        except BaseException:
            connection.rollback()
            raise


def has_table(spark: SparkSession, url: str, table: str) -> bool:
    with _connected(spark, url) as connection:
        schema, _, name = table.rpartition(".")
        return connection.getMetaData().getTables(None, schema or None, name, None).next()


def ensure_jdbc_ledger(spark: SparkSession, shard: Shard) -> None:
    """The ledger's table, made once for each database; two that make it at once are one."""
    if not has_table(spark, shard.url, LEDGER_TABLE):
        try:
            execute(spark, shard.url, [_LEDGER_DDL])
        except Py4JJavaError:
            if not has_table(spark, shard.url, LEDGER_TABLE):
                raise


def write_jdbc(rows: DataFrame, shards: Sequence[Shard], table: str, batch_id: str, id_column: str, batch: int = 50_000, **options: str) -> dict[str, int]:
    """Insert each target shard's rows whose keys its ledger doesn't have; returns how many by shard.

    rows: routed, with the ledger's key, a row a key. They are dealt to files by
    shard in one pass. Each shard's tasks copy their rows to a staging table;
    then one transaction claims the new keys in the ledger and inserts their
    rows. A retry replaces the staging table and finds the keys claimed, so no
    row is inserted twice, whenever the first try broke off.
    """
    spark, path = rows.sparkSession, workspace(rows.sparkSession, "jdbc")
    columns = [c for c in rows.columns if c not in {id_column, "target_db", "source_db", "key_field", "key_value", *KEY}]
    narrow = rows.select(*KEY, "target_db", *[F.col(f"`{c}`") for c in columns])
    write_shards(narrow, path)
    schema, stage, done = narrow.drop("target_db").schema, f"{table}_stage", {}
    keys, names = ", ".join(f'"{c}"' for c in KEY), ", ".join(quoted(c) for c in columns)
    same = " AND ".join(f'l."{c}" = s."{c}"' for c in KEY)
    kinds = [f"`{f.name}` VARCHAR({250 if f.name in KEY else 4000})" for f in schema if f.dataType == StringType()]
    number = batch_id.replace("'", "''")
    for shard in shards:
        mine = spark.read.schema(schema).parquet(f"{path}/target_db={shard.id}") if has_files(spark, f"{path}/target_db={shard.id}") else None
        if mine is None:
            done[shard.id] = 0
            continue
        ensure_jdbc_ledger(spark, shard)
        if has_table(spark, shard.url, stage):
            execute(spark, shard.url, [f"DROP TABLE {quoted(stage)}"])
        mine.write.jdbc(shard.url, quoted(stage), "append", {"batchsize": str(batch), "createTableColumnTypes": ", ".join(kinds)} | options)
        ledger = f'"{LEDGER_TABLE}"'
        done[shard.id] = execute(spark, shard.url, [
            f"DELETE FROM {quoted(stage)} WHERE EXISTS (SELECT 1 FROM {ledger} l WHERE {same.replace('s.', quoted(stage) + '.')})",
            f"INSERT INTO {ledger} ({keys}, \"batch_id\") SELECT {keys}, '{number}' FROM {quoted(stage)}",
            f"INSERT INTO {quoted(table)} ({names}) SELECT {names} FROM {quoted(stage)}",
            f"DELETE FROM {quoted(stage)}",
        ])[2]
        execute(spark, shard.url, [f"DROP TABLE {quoted(stage)}"])
    return done


def has_files(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def source_union(frames: dict[str, DataFrame]) -> DataFrame:
    """All source shards' rows, each with its shard."""
    return reduce(lambda a, b: a.unionByName(b), [df.withColumn("source_db", F.lit(name)) for name, df in frames.items()])


def write_shards(rows: DataFrame, path: str, sort: Sequence[str] = ()) -> None:
    """Files by target shard, sorted within (for the readers' statistics) where an index would be."""
    (rows.sortWithinPartitions("target_db", *sort) if sort else rows).write.partitionBy("target_db").parquet(path)
