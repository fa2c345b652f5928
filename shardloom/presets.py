"""The topologies and table specs of the registered queries."""

from __future__ import annotations

from datetime import datetime

from .spec import HASH_MOD, Rule, Shard, ShardKey, TableSpec, Topology

_SHARDS = (Shard("db1", "db1"), Shard("db2", "db2"), Shard("db3", "postgres3.example.com:5432"), Shard("db4", "postgres4.example.com:5432"))
V1, V2 = Topology("v1", _SHARDS[:2]), Topology("v2", _SHARDS)

ORDERS = TableSpec("orders", ShardKey("o_orderkey", unique=True), range_column="o_orderdate", id_column="o_orderkey")
#: By rule, low-priority orders go by customer; not unique, so the first of a key wins.
ORDERS_BY_RULE = TableSpec("orders", ShardKey(default="o_orderkey", rules=(Rule("o_orderpriority", "5-LOW", "o_custkey"),)), range_column="o_orderdate", id_column="o_orderkey")
EVENTS = TableSpec("events", ShardKey("user_id", unique=True), range_column="ts", id_column="event_id")
EVENTS_BY_RULE = TableSpec("events", ShardKey(default="user_id", rules=(Rule("event_type", "purchase", "event_id"), Rule("event_type", "view", "value"))), range_column="ts", id_column="event_id")
CUSTOMERS = TableSpec("customer", ShardKey("c_custkey", unique=True), algorithm=HASH_MOD, id_column="c_custkey")

SCAN_FROM, SCAN_TO = datetime(1996, 1, 1), datetime(1997, 1, 1)
AFTER_AT, AFTER_ID = datetime(1996, 3, 1), 5000
DATE_FROM, DATE_TO = datetime(2024, 1, 1), datetime(2024, 1, 2)
PAGED_FROM, PAGED_TO = datetime(1996, 1, 1), datetime(1996, 3, 1)
