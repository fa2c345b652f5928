"""Small tables with the same literals for Spark and for the SQL that checks it."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession

SQL_TYPES = {"string": "VARCHAR", "long": "BIGINT", "int": "INTEGER", "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP", "array<string>": "VARCHAR[]"}


def literal(value: object) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(value).upper()
    if isinstance(value, int):
        return str(value)
    if isinstance(value, list):
        return "[" + ", ".join(map(literal, value)) + "]"
    text = value.isoformat(sep=" ") if isinstance(value, datetime) else str(value)
    return "'" + text.replace("'", "''") + "'"


@dataclass(frozen=True)
class Fixture:
    name: str
    columns: str  # "name type, ..."
    rows: tuple

    @property
    def fields(self) -> list[tuple[str, str]]:
        return [tuple(c.split()) for c in self.columns.split(", ")]

    def df(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(list(self.rows), self.columns)

    def cte(self) -> str:
        """``name AS (...)`` with typed columns."""
        casts = ", ".join(f"CAST({n} AS {SQL_TYPES[t]}) AS {n}" for n, t in self.fields)
        values = ", ".join("(" + ", ".join(map(literal, row)) + ")" for row in self.rows)
        return f"{self.name} AS (SELECT {casts} FROM (VALUES {values}) v({', '.join(n for n, _ in self.fields)}))"


def ts(text: str) -> datetime:
    return datetime.fromisoformat(text)


TASK = "task_id string, table_name string, source_db string, range_from timestamp_ntz, range_to timestamp_ntz, status string, generation long, claim_token string, worker_id string, sequence_number int, batch_size int"

TASKS = Fixture(
    "tasks",
    TASK,
    (
        ("t1", "orders", "db1", ts("2024-01-01 00:00"), ts("2024-01-01 01:00"), "COMPLETED", 1, "a1", "w1", 1, 0),
        ("t2", "orders", "db1", ts("2024-01-01 01:00"), ts("2024-01-01 02:00"), "COMPLETED", 1, "a2", "w2", 2, 0),
        ("t3", "orders", "db1", ts("2024-01-01 03:00"), ts("2024-01-01 04:00"), "COMPLETED", 2, "a3", "w1", 3, 0),
        ("t4", "orders", "db2", ts("2024-01-01 01:00"), ts("2024-01-01 02:00"), "COMPLETED", 1, "a4", "w2", 4, 0),
        ("t5", "orders", "db2", ts("2024-01-01 02:00"), ts("2024-01-01 03:00"), "RUNNING", 1, "a5", "w1", 5, 0),
        ("t6", "users", "db1", ts("2024-01-01 00:00"), ts("2024-01-01 01:00"), "ASSIGNED", 2, "a6", "w3", 6, 20000),
        ("t7", "users", "db2", ts("2024-01-01 05:00"), ts("2024-01-01 06:00"), "CREATED", 0, None, None, 8, 5),
        ("t8", "users", "db2", ts("2024-01-01 06:00"), ts("2024-01-01 07:00"), "AVAILABLE", 1, None, None, 7, 0),
        ("t9", "users", "db3", ts("2024-01-01 00:00"), ts("2024-01-01 01:00"), "COMPLETED", 1, "a9", "w3", 9, 0),
        ("t10", "users", "db3", ts("2024-01-01 01:00"), ts("2024-01-01 02:00"), "COMPLETED", 1, "a10", "w3", 10, 0),
        ("t11", "users", "db3", ts("2024-01-01 02:00"), ts("2024-01-01 02:30"), "COMPLETED", 1, "a11", "w3", 11, 0),
    ),
)
CHECKPOINTS = Fixture(
    "checkpoints",
    "table_name string, source_db string, position timestamp_ntz",
    (
        ("orders", "db1", ts("2024-01-01 01:00")), ("orders", "db2", ts("2024-01-01 00:30")), ("users", "db1", ts("2024-01-02 00:00")),
        ("users", "db2", ts("2024-01-01 05:00")), ("users", "db3", None), ("events", "db1", ts("2024-03-01 00:00")), ("events", "db2", ts("2024-02-15 12:00")),
    ),
)
LOCKS = Fixture(
    "locks",
    "task_id string, generation long, claim_token string",
    (("t5", 1, "a5"), ("t3", 2, "a3"), ("t4", 1, "zz")),
)
SCOPES = Fixture("scopes", "table_name string, source_db string", tuple((t, d) for t in ("orders", "users", "events") for d in ("db1", "db2")))
LIMITS = Fixture("limits", "source_db string, max_source int", (("db1", 2), ("db2", 2), ("db3", 3), ("db4", 3)))
SLOTS = Fixture("slots", "source_db string, slot string, task_id string", (("db1", "001", "t1"), ("db1", "002", "t6"), ("db2", "001", "t5"), ("db2", "002", "gone")))
MEMBERS = Fixture("members", "member_id string", (("pod-0",), ("pod-1",), ("pod-2",), ("pod-3",)))
SHARDS = Fixture("shards", "source_db string", (("db1",), ("db2",)))
TOPOLOGIES = Fixture("topologies", "version string, shards array<string>", (("v1", ["db1", "db2"]), ("v2", ["db1", "db2", "db3", "db4"])))
TABLES = Fixture(
    "tables_cfg",
    "table_name string, enabled boolean, partitioned boolean, index_when_complete boolean",
    (("orders", True, False, True), ("users", True, False, True), ("events", False, True, True), ("logs", False, True, False)),
)
MOVES = Fixture(
    "moves",
    "scope string, before_at timestamp_ntz, after_at timestamp_ntz",
    (
        ("a", ts("2024-01-31 23:00"), ts("2024-02-01 00:00")), ("b", ts("2024-01-10 00:00"), ts("2024-01-20 00:00")), ("c", None, ts("2024-02-01 00:00")),
        ("d", ts("2024-01-15 00:00"), ts("2024-04-01 00:00")), ("e", ts("2023-11-30 00:00"), ts("2024-01-01 00:00")), ("f", ts("2024-05-01 00:00"), ts("2024-02-01 00:00")),
    ),
)
MONTHS = Fixture(
    "months",
    "table_name string, month string, month_end timestamp_ntz",
    (("events", "2024-01", ts("2024-02-01 00:00")), ("events", "2024-02", ts("2024-03-01 00:00")), ("logs", "2024-01", ts("2024-02-01 00:00"))),
)
NAMES = Fixture(
    "names",
    "table_name string, date_column string, id_column string, month_at timestamp_ntz",
    (
        ("orders", "created_at", "id", ts("2024-01-01 00:00")), ("public.users", "created_at", "id", ts("2024-11-15 08:30")),
        ("orders_" + "very_long_partition_name_" * 4, "created_at", "id", ts("1999-12-31 23:59")),
    ),
)
STATUSES = Fixture(
    "statuses",
    "table_name string, target_db string, month string, status string",
    (("events", "db3", "2024-01", "CREATED"), ("events", "db4", "2024-01", "FAILED")),
)
COMMANDS = Fixture(
    "commands",
    "what string, state string",
    tuple((c, s) for c in ("START", "STOP", "RESUME") for s in (None, "RUNNING", "STOPPED", "COMPLETED")),
)
EVENTS = Fixture(
    "task_events",
    "event string, state string",
    tuple((e, s) for e in ("CLAIM", "BEGIN", "COMPLETE", "RELEASE") for s in ("CREATED", "ASSIGNED", "RUNNING", "COMPLETED", "AVAILABLE")),
)
UNTIMED = Fixture(
    "untimed",
    "id long, seen_at timestamp_ntz",
    ((1, ts("2024-01-01 00:00")), (2, None), (3, ts("2024-01-01 00:59:59")), (4, ts("2024-01-01 01:00")), (5, None)),
)
DOCUMENTS = Fixture(
    "state_docs",
    "key string, value string",
    (
        ("segments/migration/m1/tasks/t1", '{"taskId":"t1","table":"orders","generation":2,"legacyField":"x"}'),
        ("segments/migration/m1/tasks/t2", '{"taskId":"t2","table":"users","generation":1}'),
        ("segments/migration/m1/checkpoints/orders/db1", '{"table":"orders"}'),
        ("segments/migration/m10/tasks/t9", '{"taskId":"t9","table":"orders","generation":3}'),
        ("segments/members/pod-1", "{}"),
    ),
)
