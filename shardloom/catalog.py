"""Registry of the engine's queries, each with the SQL that checks it in another engine.

The SQL computes the ring and its lookup in its own way (a recursive query and
an as-of join), progress by walking, and so on, so that agreement is evidence.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import replace
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import fixtures as fx
from . import presets as pr
from .functions import hashing, naming
from .operators import ledger, routing, scan
from .plans import extensions, planner, progress, state
from .sources import state_store
from .engine import BulkMove, move_id
from .sources.shards import source_union as union_of_shards
from .sources.shards import write_shards
from .sources.workspace import workspace
from .spec import Move, Topology, tables_from
from .streaming import incremental

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str):
    def register(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---- SQL building blocks


def _crc_table() -> list[int]:
    out = []
    for n in range(256):
        for _ in range(8):
            n = n >> 1 ^ (0xEDB88320 if n & 1 else 0)  # the standard reflected polynomial
        out.append(n)
    return out


TAB = f"tab AS (SELECT {_crc_table()}::BIGINT[] AS t)"


def _crc(listed: str) -> str:
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {listed}), lambda acc, b: xor(acc >> 8, tab.t[(xor(acc, b) & 255) + 1])), 4294967295::BIGINT)"


def _bytes(text: str) -> str:
    return f"list_transform(range(1, length({text}) + 1), lambda i: ascii(substr({text}, i, 1))::BIGINT)"


def _ring(*topologies: Topology) -> str:
    """CTEs up to ring(version, p, node)."""
    servers = ", ".join(f"('{t.version}', {i}, '{s.id}', '{s.ring_server}', {s.ring_weight * t.points})" for t in topologies for i, s in enumerate(t.shards))
    host, port = "CASE WHEN regexp_matches(server, '^.+:[0-9]*$') THEN regexp_extract(server, '^(.+):[0-9]*$', 1) ELSE server END", "regexp_extract(server, '^.+:([0-9]*)$', 1)"
    return f"""{TAB},
servers AS (SELECT * FROM (VALUES {servers}) v(version, ord, node, server, n)),
bases AS (SELECT version, ord, node, n, list_concat(list_append({_bytes("h")}, 0::BIGINT), {_bytes("pt")}) AS base FROM (SELECT *, {host} AS h, {port} AS pt FROM servers)),
points AS (
  SELECT version, ord, node, n, base, 1 AS i, {_crc("list_concat(base, [0, 0, 0, 0]::BIGINT[])")} AS p FROM bases, tab
  UNION ALL
  SELECT version, ord, node, n, base, i + 1, {_crc("list_concat(base, [p & 255, (p >> 8) & 255, (p >> 16) & 255, (p >> 24) & 255]::BIGINT[])")} FROM points, tab WHERE i < n),
ring AS (SELECT version, p, arg_max(node, ord) AS node FROM points GROUP BY version, p)"""


def _locate(rows: str, version: str, out: str, name: str) -> str:
    """CTE ``name``: the rows (with h) and their shard as ``out``."""
    return f"""{name} AS (SELECT k.*, coalesce(r.node, (SELECT arg_min(node, p) FROM ring WHERE version = '{version}')) AS {out}
FROM {rows} k ASOF LEFT JOIN (SELECT p, node FROM ring WHERE version = '{version}') r ON k.h <= r.p)"""


def _routed(keyed: str) -> str:
    """CTEs up to routed, from SQL with key_value."""
    return f"""{_ring(pr.V1, pr.V2)},
keyed AS ({keyed}),
hashes AS (SELECT key_value, {_crc(_bytes("key_value"))} AS h FROM (SELECT DISTINCT key_value FROM keyed), tab),
hashed AS (SELECT keyed.*, h FROM keyed JOIN hashes USING (key_value)),
{_locate("hashed", "v1", "source_db", "located")},
{_locate("located", "v2", "target_db", "routed")}"""


def _ts(at: datetime) -> str:
    return f"TIMESTAMP '{at.isoformat(sep=' ')}'"


def _with(*parts: str) -> str:
    return "WITH " + ", ".join(parts)


_ORDERS_RULE = "CASE WHEN o_orderpriority = '5-LOW' THEN CAST(o_custkey AS VARCHAR) ELSE CAST(o_orderkey AS VARCHAR) END"
_ORDERS_KEYED = "SELECT *, 'o_orderkey' AS key_field, CAST(o_orderkey AS VARCHAR) AS key_value FROM orders"
_EVENTS_KEYED = "SELECT *, 'user_id' AS key_field, CAST(user_id AS VARCHAR) AS key_value FROM events"


# ---- scans


@query(f"SELECT * FROM orders WHERE o_orderdate >= {_ts(pr.SCAN_FROM)} AND o_orderdate < {_ts(pr.SCAN_TO)} ORDER BY o_orderdate, o_orderkey")
def range_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan.range_scan(table(spark, sf_dir, "orders"), "o_orderdate", "o_orderkey", pr.SCAN_FROM, pr.SCAN_TO)


@query(f"SELECT * FROM orders WHERE o_orderdate >= {_ts(pr.SCAN_FROM)} AND o_orderdate < {_ts(pr.SCAN_TO)} ORDER BY o_orderdate, o_orderkey LIMIT 100")
def keyset_first_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan.range_scan(table(spark, sf_dir, "orders"), "o_orderdate", "o_orderkey", pr.SCAN_FROM, pr.SCAN_TO, limit=100)


@query(f"SELECT * FROM orders WHERE (o_orderdate, o_orderkey) > ({_ts(pr.AFTER_AT)}, {pr.AFTER_ID}) AND o_orderdate < {_ts(pr.SCAN_TO)} ORDER BY o_orderdate, o_orderkey LIMIT 100")
def keyset_next_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan.range_scan(table(spark, sf_dir, "orders"), "o_orderdate", "o_orderkey", pr.SCAN_FROM, pr.SCAN_TO, scan.Cursor(pr.AFTER_AT, pr.AFTER_ID), 100)


@query("""WITH numbered AS (
  SELECT date_trunc('year', o_orderdate) AS slice, o_orderdate, o_orderkey, (row_number() OVER (PARTITION BY date_trunc('year', o_orderdate) ORDER BY o_orderdate, o_orderkey) - 1) // 500 AS page FROM orders)
SELECT CAST(slice AS TIMESTAMP) AS slice, CAST(page AS BIGINT) AS page, count(*) AS n_rows, max(o_orderdate) AS last_at, CAST(arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS BIGINT) AS last_id, count(*) < 500 AS exhausted
FROM numbered GROUP BY slice, page""")
def keyset_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    year = F.date_trunc("year", F.col("o_orderdate")).cast("timestamp_ntz")
    paged = scan.pages(table(spark, sf_dir, "orders"), [year], "o_orderdate", "o_orderkey", 500)
    return paged.select(F.col("_w0").alias("slice"), "page", "n_rows", F.col("last.at").alias("last_at"), F.col("last.id").alias("last_id"), "exhausted")


@query(_with(fx.UNTIMED.cte()) + " SELECT count(*) - count(seen_at) AS unscanned, count(seen_at) AS timed, count(*) FILTER (WHERE seen_at >= TIMESTAMP '2024-01-01 00:00:00' AND seen_at < TIMESTAMP '2024-01-01 01:00:00') AS in_range FROM untimed")
def null_range_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fx.UNTIMED.df(spark)
    inside = F.count_if(scan.in_range("seen_at", datetime(2024, 1, 1), datetime(2024, 1, 1, 1)))
    return rows.agg(F.count_if(F.col("seen_at").isNull()).alias("unscanned"), F.count("seen_at").alias("timed"), inside.alias("in_range"))


_PAGE = 400


@query(f"""WITH r AS (SELECT o_orderdate, o_orderkey, (row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1) // {_PAGE} AS page FROM orders WHERE o_orderdate >= {_ts(pr.PAGED_FROM)} AND o_orderdate < {_ts(pr.PAGED_TO)}),
full_pages AS (SELECT page, count(*) AS n, max(o_orderdate) AS last_at, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS id FROM r GROUP BY page),
last AS (SELECT coalesce(max(page) FILTER (WHERE n < {_PAGE}), max(page) + 1, 0) AS page FROM full_pages)
SELECT CAST(page AS BIGINT) AS page, CAST(n AS BIGINT) AS n_rows, last_at AS cursor_at, CAST(id AS BIGINT) AS cursor_id, n < {_PAGE} AS exhausted FROM full_pages
UNION ALL SELECT last.page, 0, {_ts(pr.PAGED_TO)}, (SELECT arg_max(o_orderkey, (o_orderdate, o_orderkey)) FROM r), true FROM last WHERE last.page NOT IN (SELECT page FROM full_pages)""")
def page_loop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages read one after another, each from the cursor of the last, until one isn't full."""
    rows, cursor, out = table(spark, sf_dir, "orders").select("o_orderdate", "o_orderkey"), scan.Cursor(), []
    while not out or not out[-1][4]:
        page = scan.read_page(rows, "o_orderdate", "o_orderkey", pr.PAGED_FROM, pr.PAGED_TO, cursor, _PAGE)
        cursor = page.cursor
        out.append((len(out), page.n, cursor.at, cursor.id, page.exhausted))
    return spark.createDataFrame(out, "page long, n_rows long, cursor_at timestamp_ntz, cursor_id long, exhausted boolean")


# ---- keys and routing


@query(f"""SELECT 'orders' AS table_name, CAST(o_orderkey AS BIGINT) AS id, CASE WHEN o_orderpriority = '5-LOW' THEN 'o_custkey' ELSE 'o_orderkey' END AS key_field, {_ORDERS_RULE} AS key_value FROM orders
UNION ALL SELECT 'events', event_id, CASE event_type WHEN 'purchase' THEN 'event_id' WHEN 'view' THEN 'value' ELSE 'user_id' END, CASE event_type WHEN 'purchase' THEN CAST(event_id AS VARCHAR) WHEN 'view' THEN CAST(value AS VARCHAR) ELSE CAST(user_id AS VARCHAR) END FROM events""")
def shard_key_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = None
    for spec, rows in ((pr.ORDERS_BY_RULE, table(spark, sf_dir, "orders")), (pr.EVENTS_BY_RULE, table(spark, sf_dir, "events"))):
        keyed = rows.select(F.lit(spec.table).alias("table_name"), F.col(spec.id_column).cast("long").alias("id"), routing.key_field(spec.shard_key).alias("key_field"), routing.key_text(spec.shard_key).alias("key_value"))
        out = keyed if out is None else out.unionByName(keyed)
    return out


@query(f"WITH {TAB} SELECT c_custkey, {_crc(_bytes('k'))} AS h FROM (SELECT c_custkey, CAST(c_custkey AS VARCHAR) AS k FROM customer), tab")
def key_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", hashing.key_hash(F.col("c_custkey")).alias("h"))


@query(f"WITH {TAB}, hashed AS (SELECT c_custkey, {_crc(_bytes('k'))} AS h FROM (SELECT c_custkey, CAST(c_custkey AS VARCHAR) AS k FROM customer), tab) SELECT c_custkey, ['db1', 'db2'][h % 2 + 1] AS source_db, ['db1', 'db2', 'db3', 'db4'][h % 4 + 1] AS target_db FROM hashed")
def hash_mod_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    return routing.route(table(spark, sf_dir, "customer"), pr.CUSTOMERS, pr.V1, pr.V2).select("c_custkey", "source_db", "target_db")


@query(f"WITH RECURSIVE {_ring(pr.V1, pr.V2)} SELECT version, p AS point, node, count(*) OVER (PARTITION BY version) AS ring_size FROM ring")
def ring_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(t.version, p, node) for t in (pr.V1, pr.V2) for p, node in hashing.ring(t)]
    return spark.createDataFrame(rows, "version string, point long, node string").withColumn("ring_size", F.count("*").over(Window.partitionBy("version")))


def _orders_routed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return routing.route(table(spark, sf_dir, "orders"), pr.ORDERS, pr.V1, pr.V2)


@query(f"WITH RECURSIVE {_routed(_ORDERS_KEYED)} SELECT o_orderkey, h, source_db AS shard FROM routed")
def ketama_route_v1(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select("o_orderkey", hashing.key_hash(F.col("o_orderkey")).alias("h"))
    return routing.on_ring(rows, "h", pr.V1, "shard")


@query(f"WITH RECURSIVE {_routed(_ORDERS_KEYED)} SELECT o_orderkey, h, target_db AS shard FROM routed")
def ketama_route_v2(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select("o_orderkey", hashing.key_hash(F.col("o_orderkey")).alias("h"))
    return routing.on_ring(rows, "h", pr.V2, "shard")


@query(f"WITH RECURSIVE {_routed(_EVENTS_KEYED)} SELECT target_db, count(*) AS n_rows, count(DISTINCT key_value) AS n_keys FROM routed GROUP BY target_db")
def route_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    routed = routing.route(table(spark, sf_dir, "events"), pr.EVENTS, pr.V1, pr.V2)
    # by key first: a hot key is summed where it lies
    keys = routed.groupBy("target_db", "key_value").agg(F.count("*").alias("n"))
    return keys.groupBy("target_db").agg(F.sum("n").alias("n_rows"), F.count("*").alias("n_keys"))


@query(f"WITH RECURSIVE {_routed(_ORDERS_KEYED)} SELECT o_orderkey, key_value, source_db, target_db FROM routed WHERE source_db <> target_db")
def moved_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return routing.moved(_orders_routed(spark, sf_dir)).select("o_orderkey", "key_value", "source_db", "target_db")


@query(f"WITH RECURSIVE {_routed(_ORDERS_KEYED)} SELECT source_db, target_db, count(*) AS n_rows, source_db <> target_db AS moves FROM routed GROUP BY source_db, target_db")
def move_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orders_routed(spark, sf_dir).groupBy("source_db", "target_db").agg(F.count("*").alias("n_rows")).withColumn("moves", F.col("source_db") != F.col("target_db"))


@query(_with(fx.TOPOLOGIES.cte()) + " SELECT c.version AS current, t.version AS target, unnest(list_filter(t.shards, lambda x: NOT list_contains(c.shards, x))) AS shard FROM topologies c, topologies t WHERE c.version <> t.version")
def new_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = fx.TOPOLOGIES.df(spark)
    pairs = t.alias("c").crossJoin(t.alias("t")).where("c.version <> t.version")
    return pairs.select(F.col("c.version").alias("current"), F.col("t.version").alias("target"), F.explode(routing.new_shards(F.col("c.shards"), F.col("t.shards"))).alias("shard"))


@query(_with(fx.LIMITS.cte(), fx.TASKS.cte()) + " SELECT source_db FROM limits UNION SELECT source_db FROM tasks")
def known_dbs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.LIMITS.df(spark).select("source_db").union(fx.TASKS.df(spark).select("source_db")).distinct()


@query(f"WITH RECURSIVE {_routed(_ORDERS_KEYED)} SELECT o_orderkey, o_orderdate, source_db FROM routed")
def source_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, path = _orders_routed(spark, sf_dir).select("o_orderkey", "o_orderdate", F.col("source_db").alias("target_db")), workspace(spark, "shards")
    write_shards(rows, path)  # one pass; then each shard is read by itself
    schema = rows.drop("target_db").schema
    return union_of_shards({s: spark.read.schema(schema).parquet(f"{path}/target_db={s}") for s in pr.V1.ids}).select("o_orderkey", "o_orderdate", "source_db")


# ---- ledger

_LINES = "l_shipdate, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus"


@query(f"SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY {_LINES}) AS rn FROM lineitem) WHERE rn = 1")
def ledger_first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.first_wins(table(spark, sf_dir, "lineitem"), ["l_orderkey"], [F.col(c) for c in _LINES.split(", ")])


@query(f"""WITH RECURSIVE {_routed(_ORDERS_KEYED)} SELECT 'm1' AS migration_id, 'orders' AS source_table, key_field AS shard_key_field, key_value AS shard_key_value, o_orderkey, target_db
FROM routed WHERE source_db <> target_db AND key_value NOT IN (SELECT CAST(o_orderkey AS VARCHAR) FROM orders WHERE o_orderkey % 3 = 0)""")
def ledger_skip_existing(spark: SparkSession, sf_dir: str) -> DataFrame:
    routed = routing.moved(_orders_routed(spark, sf_dir)).withColumns(ledger.ledger_key("m1", "orders"))
    held = table(spark, sf_dir, "orders").where("o_orderkey % 3 = 0").select(F.lit("o_orderkey").alias("key_field"), F.col("o_orderkey").cast("string").alias("key_value")).withColumns(ledger.ledger_key("m1", "orders"))
    return ledger.not_in_ledger(routed, held).select(*ledger.KEY, "o_orderkey", "target_db")


@query(f"WITH RECURSIVE {_routed(_ORDERS_KEYED)} SELECT o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority, target_db FROM routed WHERE source_db <> target_db")
def insert_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = routing.moved(_orders_routed(spark, sf_dir)).drop("key_field", "key_value", "source_db")
    return ledger.insert_rows(rows, "o_orderkey")


@query("SELECT o_orderdate, o_orderkey, o_orderpriority, o_custkey FROM orders")
def required_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(*pr.ORDERS_BY_RULE.required_columns())


# ---- planning

_FROM, _TO = f"{_ts(pr.DATE_FROM)}", f"{_ts(pr.DATE_TO)}"
_CUT = datetime(2024, 1, 1, 23, 40)


@query(_with(fx.SCOPES.cte()) + f""", g AS (SELECT table_name, source_db, unnest(generate_series({_FROM}, {_ts(_CUT)}, INTERVAL 60 MINUTE)) AS range_from FROM scopes)
SELECT table_name, source_db, range_from, least(range_from + INTERVAL 60 MINUTE, {_ts(_CUT)}) AS range_to FROM g WHERE range_from < {_ts(_CUT)}""")
def slice_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    scopes = fx.SCOPES.df(spark).withColumns({"_start": scan.timestamp(pr.DATE_FROM), "_end": scan.timestamp(_CUT)})
    return planner.slices(scopes, "_start", "_end", 60).select("table_name", "source_db", "range_from", "range_to")


_NEXT = f"""starts AS (SELECT s.table_name, s.source_db, greatest({_FROM}, coalesce(c.position, {_FROM}), coalesce(t.m, {_FROM})) AS next_from FROM scopes s
LEFT JOIN checkpoints c ON c.table_name = s.table_name AND c.source_db = s.source_db
LEFT JOIN (SELECT table_name, source_db, max(range_to) AS m FROM tasks WHERE status <> 'COMPLETED' GROUP BY ALL) t ON t.table_name = s.table_name AND t.source_db = s.source_db)"""


def _starts(spark: SparkSession) -> DataFrame:
    return planner.next_start(fx.SCOPES.df(spark), fx.CHECKPOINTS.df(spark), planner.active(fx.TASKS.df(spark)), scan.timestamp(pr.DATE_FROM))


@query(_with(fx.SCOPES.cte(), fx.CHECKPOINTS.cte(), fx.TASKS.cte(), _NEXT) + " SELECT * FROM starts")
def next_range_start(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _starts(spark)


_PLAN = f"""free AS (SELECT greatest(0, least((SELECT count(*) FROM members WHERE member_id <> 'pod-0'), 5) - (SELECT count(*) FROM tasks WHERE status IN ('RUNNING', 'ASSIGNED'))) AS n, (SELECT coalesce(max(sequence_number), 0) FROM tasks WHERE status <> 'COMPLETED') AS last),
ranked AS (SELECT *, row_number() OVER (ORDER BY table_name, source_db) AS rn FROM starts WHERE next_from < {_TO})
SELECT 'task-' || table_name || '-' || source_db || '-' || strftime(next_from, '%Y%m%dT%H%M%S') AS task_id, table_name, source_db, next_from AS range_from, least(next_from + INTERVAL 60 MINUTE, {_TO}) AS range_to,
'CREATED' AS status, CAST(0 AS BIGINT) AS generation, CAST(rn + last AS INTEGER) AS sequence_number FROM ranked, free WHERE rn <= n"""


@query(_with(fx.SCOPES.cte(), fx.CHECKPOINTS.cte(), fx.TASKS.cte(), fx.MEMBERS.cte(), _NEXT) + ", " + _PLAN)
def capped_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    tasks = planner.active(fx.TASKS.df(spark))
    free, last = capacity(spark, sf_dir).first()["free"], planner.last_sequence(tasks)
    return planner.plan_next(_starts(spark), scan.timestamp(pr.DATE_TO), 60, free, last, ["table_name", "source_db"])


@query(_with(fx.SCOPES.cte()) + f" SELECT 'task-' || table_name || '-' || source_db || '-' || strftime({_ts(_CUT)}, '%Y%m%dT%H%M%S') AS task_id FROM scopes")
def task_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.SCOPES.df(spark).select(naming.task_id(F.col("table_name"), F.col("source_db"), scan.timestamp(_CUT)).alias("task_id"))


@query(f"""WITH RECURSIVE {_routed(_EVENTS_KEYED)} SELECT source_db, time_bucket(INTERVAL 60 MINUTE, ts, TIMESTAMP '2024-01-01 00:15:00') AS range_from, count(*) AS rows_read, count(*) FILTER (WHERE source_db <> target_db) AS rows_moved
FROM routed GROUP BY ALL""")
def slice_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = routing.route(table(spark, sf_dir, "events"), pr.EVENTS, pr.V1, pr.V2)
    by_slice = rows.groupBy("source_db", F.window("ts", "60 minutes", startTime="15 minutes").alias("w"))
    return by_slice.agg(F.count("*").alias("rows_read"), F.count_if(F.col("source_db") != F.col("target_db")).alias("rows_moved")).select("source_db", F.col("w.start").alias("range_from"), "rows_read", "rows_moved")


_SIZED = """sized AS (SELECT *, generation > 1 AS idempotent, source_db IN ('db1', 'db2') AS active_source, CAST(CASE WHEN batch_size > 0 THEN batch_size ELSE 50000 END AS BIGINT) AS whole FROM tasks),
sizes AS (SELECT task_id, source_db, idempotent, active_source, CAST(CASE WHEN idempotent THEN 500 WHEN active_source THEN greatest(1, whole // 10) ELSE whole END AS BIGINT) AS read_size,
CAST(CASE WHEN idempotent THEN 500 ELSE whole END AS BIGINT) AS write_size, CASE WHEN idempotent THEN 'IDEMPOTENT_INSERT' ELSE 'COPY' END AS insert_mode FROM sized)"""
_SIZE_COLUMNS = ["task_id", "source_db", "idempotent", "active_source", "read_size", "write_size", "insert_mode"]


def _sized(spark: SparkSession) -> DataFrame:
    return planner.batch_sizes(fx.TASKS.df(spark), 50_000, 500, 10, F.array(*map(F.lit, pr.V1.ids)), F.lit(False)).select(*_SIZE_COLUMNS)


@query(_with(fx.TASKS.cte(), _SIZED) + " SELECT * FROM sizes")
def batch_sizing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sized(spark)


@query(_with(fx.TASKS.cte(), _SIZED) + """ SELECT task_id, source_db, target_db, read_size, CAST(CASE WHEN idempotent OR target_db IN ('db3', 'db4') THEN write_size ELSE greatest(1, write_size // 10) END AS BIGINT) AS write_size,
CASE WHEN idempotent OR target_db IN ('db3', 'db4') THEN insert_mode ELSE 'ROW_INSERT' END AS insert_mode FROM sizes, (VALUES ('db1'), ('db2'), ('db3'), ('db4')) v(target_db)""")
def target_batch_sizing(spark: SparkSession, sf_dir: str) -> DataFrame:
    targets = _sized(spark).withColumn("target_db", F.explode(F.array(*map(F.lit, pr.V2.ids))))
    sized = planner.target_sizes(targets, 10, F.array(*map(F.lit, pr.V1.ids)), F.array(*map(F.lit, pr.V2.ids)))
    return sized.select("task_id", "source_db", "target_db", "read_size", "write_size", "insert_mode")


@query(_with(fx.TASKS.cte(), fx.LIMITS.cte()) + ", r AS (SELECT *, row_number() OVER (PARTITION BY source_db ORDER BY sequence_number, task_id) AS rn FROM tasks WHERE status <> 'COMPLETED') SELECT source_db, lpad(CAST(rn AS VARCHAR), 3, '0') AS slot, task_id FROM r JOIN limits USING (source_db) WHERE rn <= max_source")
def slot_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planner.assign_slots(planner.active(fx.TASKS.df(spark)), fx.LIMITS.df(spark)).select("source_db", "slot", "task_id")


@query(_with(fx.TASKS.cte(), fx.SLOTS.cte()) + " SELECT source_db, slot, task_id FROM slots WHERE task_id NOT IN (SELECT task_id FROM tasks WHERE status <> 'COMPLETED')")
def orphan_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planner.orphan_slots(fx.SLOTS.df(spark), fx.TASKS.df(spark)).select("source_db", "slot", "task_id")


@query(_with(fx.TASKS.cte(), fx.MEMBERS.cte()) + " SELECT w AS workers, b AS busy, CAST(greatest(0, least(w, 5) - b) AS BIGINT) AS free FROM (SELECT (SELECT count(*) FROM members WHERE member_id <> 'pod-0') AS w, (SELECT count(*) FROM tasks WHERE status IN ('RUNNING', 'ASSIGNED')) AS b)")
def capacity(spark: SparkSession, sf_dir: str) -> DataFrame:
    workers = fx.MEMBERS.df(spark).where("member_id <> 'pod-0'").agg(F.count("*").alias("workers"))
    busy = fx.TASKS.df(spark).agg(planner.running().alias("busy"))
    return workers.crossJoin(busy).withColumn("free", planner.free_places(F.col("workers"), F.lit(5), F.col("busy")).cast("long"))


@query(_with(fx.TASKS.cte()) + " SELECT task_id, generation + 1 AS generation, 'ASSIGNED' AS status, sequence_number FROM tasks WHERE status IN ('CREATED', 'AVAILABLE') ORDER BY sequence_number, task_id LIMIT 1")
def claim_next(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planner.claim_next(fx.TASKS.df(spark)).select("task_id", "generation", "status", "sequence_number")


# ---- progress


@query("WITH RECURSIVE " + fx.TASKS.cte() + ", " + fx.CHECKPOINTS.cte() + f""", done AS (SELECT t.table_name, t.source_db, range_from, range_to, coalesce(c.position, {_FROM}) AS start_at FROM tasks t LEFT JOIN checkpoints c USING (table_name, source_db) WHERE status = 'COMPLETED'),
walk AS (SELECT DISTINCT table_name, source_db, start_at AS position FROM done UNION ALL
SELECT w.table_name, w.source_db, d.range_to FROM walk w JOIN done d ON d.table_name = w.table_name AND d.source_db = w.source_db AND d.range_from = w.position AND d.range_to > d.range_from)
SELECT table_name, source_db, max(position) AS position FROM walk GROUP BY ALL""")
def checkpoint_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return progress.checkpoint_prefix(fx.TASKS.df(spark).where("status = 'COMPLETED'"), fx.CHECKPOINTS.df(spark), scan.timestamp(pr.DATE_FROM))


@query(_with(fx.TASKS.cte(), fx.CHECKPOINTS.cte()) + " SELECT task_id FROM tasks t WHERE status = 'COMPLETED' AND EXISTS (SELECT 1 FROM checkpoints c WHERE c.table_name = t.table_name AND c.source_db = t.source_db AND c.position >= t.range_to)")
def cleanup_covered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return progress.covered(fx.TASKS.df(spark).where("status = 'COMPLETED'"), fx.CHECKPOINTS.df(spark)).select("task_id")


@query(_with(fx.TASKS.cte(), fx.LOCKS.cte()) + " SELECT task_id, 'AVAILABLE' AS status, generation, CAST(NULL AS VARCHAR) AS worker_id, CAST(NULL AS VARCHAR) AS claim_token FROM tasks WHERE status IN ('RUNNING', 'ASSIGNED') AND task_id NOT IN (SELECT task_id FROM locks)")
def stale_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return progress.stale(fx.TASKS.df(spark), fx.LOCKS.df(spark)).select("task_id", "status", "generation", "worker_id", "claim_token")


@query(_with(fx.TASKS.cte(), fx.LOCKS.cte()) + " SELECT t.task_id, t.generation, t.claim_token FROM tasks t JOIN locks l ON l.task_id = t.task_id AND l.generation = t.generation AND l.claim_token = t.claim_token")
def fenced_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return progress.fenced(fx.TASKS.df(spark), fx.LOCKS.df(spark)).select("task_id", "generation", "claim_token")


@query(_with(fx.MOVES.cte()) + """ SELECT scope, strftime(m, '%Y-%m') AS month FROM (SELECT scope, before_at, after_at, unnest(generate_series(date_trunc('month', before_at), date_trunc('month', after_at), INTERVAL 1 MONTH)) AS m FROM moves WHERE before_at IS NOT NULL AND before_at < after_at)
WHERE m < date_trunc('month', after_at)""")
def months_crossed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return progress.crossed_months(fx.MOVES.df(spark), "before_at", "after_at").select("scope", "month")


@query(_with(fx.MONTHS.cte(), fx.SHARDS.cte(), fx.CHECKPOINTS.cte()) + " SELECT table_name, month FROM months m WHERE NOT EXISTS (SELECT 1 FROM shards s WHERE NOT EXISTS (SELECT 1 FROM checkpoints c WHERE c.table_name = m.table_name AND c.source_db = s.source_db AND c.position >= m.month_end))")
def complete_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    return progress.complete_months(fx.MONTHS.df(spark), fx.SHARDS.df(spark), fx.CHECKPOINTS.df(spark))


@query(_with(fx.MOVES.cte()) + " SELECT scope, strftime(after_at - INTERVAL 1 MICROSECOND, '%Y-%m') AS month FROM moves")
def final_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.MOVES.df(spark).select("scope", progress.final_month(F.col("after_at")).alias("month"))


@query(_with(fx.TABLES.cte(), fx.SHARDS.cte(), fx.CHECKPOINTS.cte()) + f""" SELECT e AS date_to, NOT EXISTS (SELECT 1 FROM tables_cfg t, shards s WHERE t.enabled AND NOT EXISTS (SELECT 1 FROM checkpoints c WHERE c.table_name = t.table_name AND c.source_db = s.source_db AND c.position >= e)) AS complete
FROM (VALUES ({_FROM}), ({_TO})) v(e)""")
def bulk_complete(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = None
    for end in (pr.DATE_FROM, pr.DATE_TO):
        row = progress.bulk_complete(fx.TABLES.df(spark), fx.SHARDS.df(spark), fx.CHECKPOINTS.df(spark), scan.timestamp(end)).select(scan.timestamp(end).alias("date_to"), "complete")
        out = row if out is None else out.unionByName(row)
    return out


# ---- names and indexes


@query(_with(fx.NAMES.cte()) + " SELECT table_name, table_name || '_' || strftime(month_at, '%Y') || '_' || strftime(month_at, '%m') AS partition, strftime(month_at, '%Y-%m') AS month FROM names")
def partition_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.NAMES.df(spark).select("table_name", naming.partition_name(F.col("table_name"), F.col("month_at")).alias("partition"), naming.month_key(F.col("month_at")).alias("month"))


def _index_name_sql(wanted: str) -> str:
    safe = f"regexp_replace({wanted}, '[^A-Za-z0-9_$]', '_', 'g')"
    return f"CASE WHEN octet_length(encode({safe})) <= 63 THEN {safe} ELSE substr({safe}, 1, 50) || '_' || substr(sha256({safe}), 1, 12) END"


_QUALIFIED = "'\"' || replace(table_name, '.', '\".\"') || '\"'"
_DDL = f"""ddl AS (SELECT table_name, {_index_name_sql("'idx_' || table_name || '_verify_' || date_column")} AS index_name, {_QUALIFIED} AS q, '"' || date_column || '"' AS cols FROM names
UNION ALL SELECT table_name, {_index_name_sql("'idx_' || table_name || '_verify_' || date_column || '_' || id_column")}, {_QUALIFIED}, '"' || date_column || '", "' || id_column || '"' FROM names)"""


@query(_with(fx.NAMES.cte(), _DDL) + """ SELECT table_name, index_name, 'CREATE INDEX IF NOT EXISTS "' || index_name || '" ON ' || q || ' (' || cols || ')' AS statement FROM ddl""")
def index_ddl(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = naming.index_statements(F.col("table_name"), F.col("date_column"), F.col("id_column"))
    return fx.NAMES.df(spark).select("table_name", F.explode(made).alias("statement")).select("table_name", naming.index_of(F.col("statement")).alias("index_name"), "statement")


@query(_with(fx.TABLES.cte(), fx.MONTHS.cte(), fx.SHARDS.cte(), fx.CHECKPOINTS.cte()) + """, done AS (SELECT table_name, month FROM months m WHERE NOT EXISTS (SELECT 1 FROM shards s WHERE NOT EXISTS (SELECT 1 FROM checkpoints c WHERE c.table_name = m.table_name AND c.source_db = s.source_db AND c.position >= m.month_end)))
SELECT table_name, month, target_db FROM (SELECT table_name, CAST(NULL AS VARCHAR) AS month FROM tables_cfg WHERE NOT partitioned UNION ALL SELECT d.table_name, d.month FROM done d JOIN tables_cfg t ON t.table_name = d.table_name WHERE partitioned AND index_when_complete), (VALUES ('db3'), ('db4')) v(target_db)""")
def index_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    fresh = spark.createDataFrame([(s,) for s in pr.V2.ids if s not in pr.V1.ids], "target_db string")
    return progress.index_targets(fx.TABLES.df(spark), complete_months(spark, sf_dir), fresh)


@query(f"""WITH RECURSIVE {_routed(_EVENTS_KEYED)}, {fx.STATUSES.cte()} SELECT event_id, target_db, strftime(ts, '%Y-%m') AS month, target_db NOT IN ('db3', 'db4') OR EXISTS (SELECT 1 FROM statuses s WHERE s.status = 'CREATED' AND s.table_name = 'events' AND s.target_db = routed.target_db AND s.month = strftime(routed.ts, '%Y-%m')) AS verify_ready
FROM routed WHERE source_db <> target_db""")
def verify_ready(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = routing.moved(routing.route(table(spark, sf_dir, "events"), pr.EVENTS, pr.V1, pr.V2))
    rows = rows.select("event_id", "target_db", F.lit("events").alias("table_name"), naming.month_key(F.col("ts")).alias("month"))
    return progress.verify_ready(rows, True, fx.STATUSES.df(spark), ["db3", "db4"]).select("event_id", "target_db", "month", "verify_ready")


_PLAIN_INDEXES = "(SELECT 'orders' AS table_name, unnest(['idx_orders_verify_created_at', 'idx_orders_verify_created_at_id']) AS index_name)"


@query(f"SELECT table_name, target_db, CAST(NULL AS VARCHAR) AS month, array_to_string(list_sort(list(index_name)), ',') AS index_names, CASE WHEN target_db = 'db4' THEN 'FAILED' ELSE 'CREATED' END AS status FROM {_PLAIN_INDEXES}, (VALUES ('db3'), ('db4')) v(target_db) GROUP BY ALL")
def index_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = naming.index_statements(F.col("table_name"), F.lit("created_at"), F.lit("id"))
    targets = spark.createDataFrame([("orders", "db3", None), ("orders", "db4", None)], "table_name string, target_db string, month string")
    statements = targets.select("*", F.explode(made).alias("statement")).withColumn("index_name", naming.index_of(F.col("statement")))
    failed = spark.createDataFrame([("db4", "idx_orders_verify_created_at_id")], "target_db string, index_name string")
    return progress.index_status(statements, failed).withColumn("index_names", F.array_join("index_names", ","))


@query(_with(fx.TABLES.cte()) + " SELECT table_name, target_db FROM tables_cfg, (VALUES ('db3'), ('db4')) v(target_db)")
def all_index_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return progress.all_index_targets(fx.TABLES.df(spark), spark.createDataFrame([("db3",), ("db4",)], "target_db string"))


@query(_with(fx.TASKS.cte()) + " SELECT table_name, source_db, count(*) AS n_ranges, max(range_to) AS last_to, max(sequence_number) AS last_sequence FROM tasks WHERE status = 'COMPLETED' GROUP BY ALL")
def completed_scopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return progress.completed_scopes(fx.TASKS.df(spark))


# ---- state


@query(_with(fx.TASKS.cte(), fx.LOCKS.cte()) + """ SELECT t.task_id, CASE WHEN l.task_id IS NOT NULL AND t.status = 'RUNNING' THEN 'COMPLETED' ELSE t.status END AS status
FROM tasks t LEFT JOIN locks l ON l.task_id = t.task_id AND l.generation = t.generation AND l.claim_token = t.claim_token""")
def task_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    tasks = fx.TASKS.df(spark)
    events = tasks.select("task_id", "generation", "claim_token", F.lit("COMPLETE").alias("event"))
    return progress.apply_events(tasks, events, fx.LOCKS.df(spark)).select("task_id", "status")


def _command_sql() -> str:
    return """ SELECT what, state, CASE WHEN what = 'START' THEN state IS NULL OR state NOT IN ('RUNNING', 'STOPPED') WHEN what = 'STOP' THEN coalesce(state = 'RUNNING', false) ELSE coalesce(state = 'STOPPED', false) END AS accepted,
CASE WHEN what = 'START' AND state IS DISTINCT FROM 'STOPPED' THEN 'RUNNING' WHEN what = 'STOP' AND state = 'RUNNING' THEN 'STOPPED' WHEN what = 'RESUME' AND state = 'STOPPED' THEN 'RUNNING' ELSE state END AS status FROM commands"""


@query(_with(fx.COMMANDS.cte()) + _command_sql())
def command_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    result = state.command_result(F.col("what"), F.col("state"))
    return fx.COMMANDS.df(spark).withColumn("r", result).select("what", "state", "r.accepted", "r.status")


@query(_with(fx.EVENTS.cte()) + " SELECT event, state, CASE WHEN event = 'CLAIM' AND state IN ('CREATED', 'AVAILABLE') THEN 'ASSIGNED' WHEN event = 'BEGIN' AND state = 'ASSIGNED' THEN 'RUNNING' WHEN event = 'COMPLETE' AND state = 'RUNNING' THEN 'COMPLETED' WHEN event = 'RELEASE' AND state IN ('RUNNING', 'ASSIGNED') THEN 'AVAILABLE' ELSE state END AS after_state FROM task_events")
def task_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.EVENTS.df(spark).withColumn("after_state", state.task_after(F.col("event"), F.col("state")))


@query(_with(fx.TASKS.cte()) + " SELECT task_id, 'segments/migration/m1/tasks/' || task_id AS task_key, 'segments/migration/m1/locks/task/' || task_id AS lock_key, 'segments/migration/m1/checkpoints/' || table_name || '/' || source_db AS checkpoint_key, 'segments/slots/source/' || source_db || '/001' AS slot_key, 'segments/migration/m1/indexes/' || source_db || '/' || table_name || '/' || strftime(range_from, '%Y-%m') AS index_key FROM tasks")
def kv_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = lambda *parts: naming.state_key("segments/", *parts)
    t, d = F.col("table_name"), F.col("source_db")
    return fx.TASKS.df(spark).select(
        "task_id", key("migration/m1/tasks", F.col("task_id")).alias("task_key"), key("migration/m1/locks/task", F.col("task_id")).alias("lock_key"), key("migration/m1/checkpoints", t, d).alias("checkpoint_key"),
        key("slots/source", d, "001").alias("slot_key"), key("migration/m1/indexes", d, t, naming.month_key(F.col("range_from"))).alias("index_key"),
    )


@query(_with(fx.DOCUMENTS.cte()) + " SELECT key, value FROM state_docs WHERE starts_with(key, 'segments/migration/m1/tasks/') ORDER BY key")
def kv_prefix_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state_store.prefix_scan(fx.DOCUMENTS.df(spark), "segments/migration/m1/tasks/")


@query(_with(fx.DOCUMENTS.cte()) + """ SELECT key, value->>'$.taskId' AS task_id, CAST(value->>'$.generation' AS BIGINT) AS generation, '{"taskId":"' || (value->>'$.taskId') || '","generation":' || (value->>'$.generation') || '}' AS again FROM state_docs WHERE contains(key, '/tasks/')""")
def json_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = fx.DOCUMENTS.df(spark).where(F.contains("key", F.lit("/tasks/"))).withColumn("d", state_store.decode(F.col("value"), "taskId string, generation long"))
    return read.select("key", F.col("d.taskId").alias("task_id"), "d.generation", state_store.encode(F.col("d")).alias("again"))


_CONFIG = """{"orders": {"enabled": true, "shardKey": {"defaultField": "op_id", "unique": true, "rules": [{"whenField": "kind", "whenValue": 12, "useField": "user_id"}]}, "businessKey": ["op_id", "day"]},
"events": {"enabled": false, "tableName": "user_events", "shardAlgorithm": "hash_mod", "rangeColumn": "seen_at", "shardKey": {"field": "client_id"}}, "logs": {"shardKey": {"field": "id"}}}"""


@query(f"""WITH c AS (SELECT unnest(json_keys(j)) AS k, j FROM (SELECT '{_CONFIG}'::JSON AS j)), t AS (SELECT k, j->k AS t FROM c),
f AS (SELECT *, t->'$.shardKey' AS s, coalesce(t->>'$.rangeColumn', 'created_at') AS range_column FROM t),
r AS (SELECT *, list_concat([range_column, 'id'], CASE WHEN s->>'$.field' IS NOT NULL THEN [s->>'$.field'] ELSE list_concat([s->>'$.defaultField'], from_json(coalesce(s->'$.rules[*].whenField', '[]'), '["VARCHAR"]'), from_json(coalesce(s->'$.rules[*].useField', '[]'), '["VARCHAR"]')) END, from_json(coalesce(t->'$.businessKey', '[]'), '["VARCHAR"]')) AS listed FROM f)
SELECT k AS key, coalesce(t->>'$.tableName', k) AS table_name, coalesce(CAST(t->>'$.enabled' AS BOOLEAN), false) AS enabled, upper(coalesce(t->>'$.shardAlgorithm', 'KETAMA')) AS algorithm, coalesce(CAST(s->>'$.unique' AS BOOLEAN), false) AS unique_key,
array_to_string(list_transform(list_filter(range(1, len(listed) + 1), lambda i: list_position(listed, listed[i]) = i), lambda i: listed[i]), ',') AS columns FROM r""")
def configured_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Table specs of a configuration document, with the columns that each needs."""
    specs = tables_from(json.loads(_CONFIG))
    rows = [(t.key, t.table, t.enabled, t.algorithm, t.shard_key.unique, ",".join(t.required_columns())) for t in specs]
    return spark.createDataFrame(rows, "key string, table_name string, enabled boolean, algorithm string, unique_key boolean, columns string")


_STARTS = [("whole", pr.DATE_FROM, pr.DATE_TO, True, True), ("no start", None, pr.DATE_TO, True, True), ("no end", pr.DATE_FROM, None, True, True), ("empty", pr.DATE_FROM, pr.DATE_FROM, True, True), ("backwards", pr.DATE_TO, pr.DATE_FROM, True, True), ("loose", pr.DATE_FROM, pr.DATE_TO, False, True), ("loose but off", pr.DATE_FROM, pr.DATE_TO, False, False)]


@query("WITH s AS (SELECT * FROM (VALUES " + ", ".join(f"('{n}', {_ts(a) if a else 'CAST(NULL AS TIMESTAMP)'}, {_ts(b) if b else 'CAST(NULL AS TIMESTAMP)'}, {u}, {e})" for n, a, b, u, e in _STARTS) + ") v(name, a, b, unique_key, enabled)) SELECT name, coalesce(a < b, false) AND (unique_key OR NOT enabled) AS accepted, CAST(enabled AS INTEGER) AS n_enabled FROM s")
def start_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which moves may start: both dates in order, and every enabled table with a unique key."""
    rows = []
    for name, start, end, unique, enabled in _STARTS:
        move = Move(name, pr.V1, pr.V2, start, end, (replace(pr.ORDERS, shard_key=replace(pr.ORDERS.shard_key, unique=unique), enabled=enabled),))
        rows.append((name, move.error() is None, len(move.enabled())))
    return spark.createDataFrame(rows, "name string, accepted boolean, n_enabled int")


@query("""SELECT * FROM (VALUES (1, 'put if absent', true), (2, 'put if absent again', false), (3, 'exists', true), (4, 'set at a late revision', false), (5, 'set at the revision', true), (6, 'read', true), (7, 'delete at a late revision', false), (8, 'delete at the revision', true), (9, 'exists after', false),
(10, 'checkpoint begins once', true), (11, 'checkpoint begins again', false), (12, 'delete by prefix', true), (13, 'others stay', true), (14, 'revisions rise', true)) v(step, what, ok)""")
def state_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state store's conditional writes and reads, in their order."""
    store = state_store.StateStore(spark, workspace(spark, "state"))
    out: list[tuple[str, bool]] = [("put if absent", store.put_if_absent("lock/m1", "a")), ("put if absent again", store.put_if_absent("lock/m1", "b")), ("exists", store.exists("lock/m1"))]
    first = store.get("lock/m1").revision
    out += [("set at a late revision", store.compare_and_set("lock/m1", "c", first - 1)), ("set at the revision", store.compare_and_set("lock/m1", "d", first)), ("read", store.get("lock/m1").value == "d")]
    second = store.get("lock/m1").revision
    out += [("delete at a late revision", store.compare_and_delete("lock/m1", first)), ("delete at the revision", store.compare_and_delete("lock/m1", second)), ("exists after", store.exists("lock/m1"))]
    out += [("checkpoint begins once", store.put_if_absent("checkpoints/orders/db1", "2024-01-01")), ("checkpoint begins again", store.put_if_absent("checkpoints/orders/db1", "2024-01-02"))]
    store.put("slots/db1/001", "t1")
    out += [("delete by prefix", store.delete_prefix("checkpoints/") and not store.prefix("checkpoints/")), ("others stay", store.exists("slots/db1/001")), ("revisions rise", store.get("slots/db1/001").revision > second > first)]
    return spark.createDataFrame([(i + 1, what, bool(ok)) for i, (what, ok) in enumerate(out)], "step int, what string, ok boolean")


@query("SELECT true AS well_formed, 25 AS n_chars, 'mig-20240101-' AS begins, true AS differ")
def move_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The form of a new move's id: its day, and a random part."""
    ids = spark.createDataFrame([(move_id(pr.DATE_FROM), move_id(pr.DATE_FROM))], "a string, b string")
    return ids.select(F.col("a").rlike("^mig-[0-9]{8}-[0-9a-f]{8}-[0-9a-f]{3}$").alias("well_formed"), F.length("a").alias("n_chars"), F.substring("a", 1, 13).alias("begins"), (F.col("a") != F.col("b")).alias("differ"))


# ---- stream


@query(f"""WITH RECURSIVE {_routed(_EVENTS_KEYED)} SELECT key_value AS shard_key_value, ts, event_type, source_db, target_db
FROM (SELECT *, row_number() OVER (PARTITION BY key_value ORDER BY ts, event_id) AS rn FROM routed WHERE source_db <> target_db) WHERE rn = 1""")
def incremental_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    work = workspace(spark, "incremental")
    schema = table(spark, sf_dir, "events").schema
    stream = incremental.arrivals(spark, sf_dir, schema, glob="events.parquet")
    incremental.run(stream, "m1", pr.EVENTS, pr.V1, pr.V2, f"{work}/data", f"{work}/ledger", f"{work}/checkpoint", [F.col("ts"), F.col("event_id")]).awaitTermination()
    return incremental.transferred(spark, f"{work}/data", f"{work}/ledger").select("shard_key_value", "ts", "event_type", "source_db", "target_db")


@query(f"""WITH RECURSIVE {_routed(_EVENTS_KEYED)} SELECT true AS caught_up, count(DISTINCT key_value) AS n_keys, (SELECT count(*) FROM events) AS n_read FROM routed WHERE source_db <> target_db""")
def stream_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream that has caught up, what it has read, and the keys that it has moved."""
    work = workspace(spark, "progress")
    stream = incremental.arrivals(spark, sf_dir, table(spark, sf_dir, "events").schema, glob="events.parquet")
    query_ = incremental.run(stream, "m1", pr.EVENTS, pr.V1, pr.V2, f"{work}/data", f"{work}/ledger", f"{work}/checkpoint", [F.col("ts"), F.col("event_id")])
    query_.awaitTermination()
    read = sum(p["numInputRows"] for p in query_.recentProgress)
    done = incremental.transferred(spark, f"{work}/data", f"{work}/ledger")
    return done.agg(F.lit(incremental.caught_up(query_)).alias("caught_up"), F.countDistinct("shard_key_value").alias("n_keys"), F.lit(read).cast("long").alias("n_read"))


# ---- whole moves

_ONE_FROM, _ONE_TO, _TWO_TO = datetime(1993, 1, 1), datetime(1996, 1, 1), datetime(1998, 1, 1)


def _order_move(ident: str, start: datetime, end: datetime) -> Move:
    return Move(ident, pr.V1, pr.V2, start, end, (pr.ORDERS,))


@query(f"""WITH RECURSIVE {_routed(_ORDERS_KEYED)} SELECT migration_id, key_value AS shard_key_value, o_orderdate, target_db FROM routed,
(VALUES ('m1', TIMESTAMP '0001-01-01'), ('m2', {_ts(_ONE_TO)})) v(migration_id, since) WHERE source_db <> target_db AND o_orderdate >= since AND (migration_id = 'm1' OR o_orderdate < {_ts(_TWO_TO)})""")
def moves_on_one_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A bulk move of some years, then a stream of all rows, of which those moved are kept out, then a second move: all at one path."""
    work, orders = workspace(spark, "moves"), table(spark, sf_dir, "orders")
    BulkMove(spark, _order_move("m1", _ONE_FROM, _ONE_TO), {"orders": orders}, work, ranges=2).run()
    data, book = f"{work}/data/orders", f"{work}/ledger/orders"
    stream = incremental.arrivals(spark, sf_dir, orders.schema, glob="orders.parquet")
    incremental.run(stream, "m1", pr.ORDERS, pr.V1, pr.V2, data, book, f"{work}/checkpoint", [F.col("o_orderdate"), F.col("o_orderkey")]).awaitTermination()
    BulkMove(spark, _order_move("m2", _ONE_TO, _TWO_TO), {"orders": orders}, work, ranges=2).run()
    return ledger.transferred(spark, data, book).select("migration_id", "shard_key_value", "o_orderdate", "target_db")


@query(f"""WITH RECURSIVE {_routed(_EVENTS_KEYED)} SELECT 'events' AS table_name, source_db, target_db, count(DISTINCT key_value) AS n_rows FROM routed WHERE source_db <> target_db AND ts >= TIMESTAMP '2023-01-01' AND ts < TIMESTAMP '2025-06-01' GROUP BY ALL""")
def resumed_move(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A move that is stopped in the middle of its table, and resumed from its last range by another object."""
    work, events = workspace(spark, "resumed"), {"events": table(spark, sf_dir, "events")}
    move = Move("m1", pr.V1, pr.V2, datetime(2023, 1, 1), datetime(2025, 6, 1), (pr.EVENTS,))
    first = BulkMove(spark, move, events, work, ranges=3)
    first.run(waves=2)
    first.stop()
    return BulkMove(spark, move, events, work, ranges=3).resume()


# ---- beyond the reference


@query(f"""WITH RECURSIVE {_routed(_ORDERS_KEYED)}, e AS (SELECT target_db, key_value FROM routed WHERE source_db <> target_db), f AS (SELECT target_db, key_value FROM e WHERE CAST(key_value AS BIGINT) % 7 <> 0)
SELECT target_db, count(*) AS n_expected, count(*) FILTER (WHERE CAST(key_value AS BIGINT) % 7 <> 0) AS n_found, count(*) FILTER (WHERE CAST(key_value AS BIGINT) % 7 = 0) AS n_missing, CAST(0 AS BIGINT) AS n_unexpected FROM e GROUP BY target_db""")
def ext_verify_move(spark: SparkSession, sf_dir: str) -> DataFrame:
    expected = routing.moved(_orders_routed(spark, sf_dir))
    return extensions.verify(expected, expected.where("cast(key_value AS long) % 7 <> 0"))


@query(f"WITH RECURSIVE {_routed(_ORDERS_KEYED)} SELECT o_orderkey, source_db FROM routed WHERE source_db = target_db")
def ext_left_at_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    routed = _orders_routed(spark, sf_dir)
    held = routing.moved(routed).withColumns(ledger.ledger_key("m1", "orders"))
    return extensions.left_at_source(routed, held).select("o_orderkey", "source_db")


@query("SELECT CAST(o_orderkey // 1000 * 1000 AS BIGINT) AS from_id, count(*) AS n_rows, CAST(o_orderkey // 1000 * 1000 + 1000 AS BIGINT) AS to_id FROM orders GROUP BY ALL")
def ext_key_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extensions.key_ranges(table(spark, sf_dir, "orders"), "o_orderkey", 1000)


@query(_with(fx.TASKS.cte(), fx.LIMITS.cte()) + """, p AS (SELECT t.task_id, t.sequence_number, v.target_db, row_number() OVER (PARTITION BY v.target_db ORDER BY sequence_number, task_id) AS rn FROM tasks t, (VALUES ('db3'), ('db4')) v(target_db) WHERE status <> 'COMPLETED')
SELECT target_db, lpad(CAST(rn AS VARCHAR), 3, '0') AS slot, task_id FROM p JOIN limits l ON l.source_db = p.target_db WHERE rn <= max_source""")
def ext_target_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = planner.active(fx.TASKS.df(spark)).withColumn("target_db", F.explode(F.array(F.lit("db3"), F.lit("db4"))))
    return extensions.target_slots(pairs, fx.LIMITS.df(spark))
