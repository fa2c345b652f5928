"""The reference's test scenarios, and randomised comparisons with plain Python."""

import bisect
import random
import zlib
from datetime import datetime, timedelta

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from shardloom import presets as pr
from shardloom import spec
from shardloom.functions import hashing, naming
from shardloom.operators import ledger, routing, scan
from shardloom.plans import planner, progress, state
from shardloom.sources.state_store import StateStore
from shardloom.streaming import incremental

PLAIN = spec.Topology("v2", tuple(spec.Shard(f"db{i}") for i in range(1, 5)))
T0 = datetime(2024, 1, 1)


def at(hours, minutes=0):
    return T0 + timedelta(hours=hours, minutes=minutes)


# ---- ring


def test_ring_anchors():
    assert zlib.crc32(b"user-123") == 2724751950
    assert hashing.chain("db1", 1) == [3800889580]
    v1 = hashing.ring(pr.V1)
    assert (len(v1), v1[0], v1[-1]) == (320, (22018066, "db2"), (4282537618, "db1"))
    v2 = hashing.ring(pr.V2)
    assert (len(v2), v2[0], v2[-1]) == (640, (8385802, "db4"), (4294072617, "db4"))
    assert hashing.locate("user-123", pr.V1) == hashing.locate("user-123", pr.V2) == "db1"


def test_ring_is_deterministic_and_reaches_all_shards():
    found = [hashing.locate(f"key-{i}", PLAIN) for i in range(1000)]
    assert {s: found.count(s) for s in PLAIN.ids} == {"db1": 264, "db2": 242, "db3": 248, "db4": 246}
    renamed = spec.Topology("v2", tuple(spec.Shard(s.id, f"host{i}:5432") for i, s in enumerate(PLAIN.shards)))
    assert found != [hashing.locate(f"key-{i}", renamed) for i in range(1000)]


def test_server_split_and_weights():
    assert hashing.host_and_port("a.b:5432") == ("a.b", "5432")
    assert hashing.host_and_port("a:x") == ("a:x", "")
    assert hashing.host_and_port("a:") == ("a", "")
    heavy = spec.Topology("w", (spec.Shard("a", weight=3), spec.Shard("b", weight=-1)))
    assert sum(s == "a" for _, s in hashing.ring(heavy)) == 480
    assert sum(s == "b" for _, s in hashing.ring(heavy)) == 160


def test_segments_cover_the_space_once():
    parts = sorted((lo, hi) for _, lo, hi, _ in hashing.segments(pr.V2))
    assert parts[0][0] == 0 and parts[-1][1] == hashing.SPACE - 1
    assert all(a[1] + 1 == b[0] for a, b in zip(parts, parts[1:]))


def test_lookup_equals_bisection_and_joins_by_hash(spark):
    rng = random.Random(3)
    hashes = [rng.randrange(2**32) for _ in range(2000)] + [0, 2**32 - 1] + [p for p, _ in hashing.ring(pr.V2)]
    df = routing.on_ring(spark.createDataFrame([(h,) for h in hashes], "h long"), "h", pr.V2, "shard")
    plan = df._jdf.queryExecution().toString()
    assert "BroadcastHashJoin" in plan and "NestedLoop" not in plan
    points = hashing.ring(pr.V2)
    keys = [p for p, _ in points]
    for h, shard in df.collect():
        i = bisect.bisect_left(keys, h)
        assert shard == points[i if i < len(points) else 0][1]


def test_topology_change_moves_rows_to_new_shards_or_within(spark):
    df = spark.range(2000).select(F.col("id").alias("o_orderkey"))
    routed = routing.route(df, pr.ORDERS, pr.V1, pr.V2)
    assert routed.count() == 2000
    assert routing.moved(routed).count() == routed.where("source_db <> target_db").count() > 0


# ---- keys


def test_rules_first_fit_wins_and_null_never_fits(spark):
    key = spec.ShardKey(default="a", rules=(spec.Rule("eq", "b12", "b"), spec.Rule("eq", "b12", "a"), spec.Rule("n", "5", "b")))
    rows = spark.createDataFrame([(1, 2, "b12", None), (1, 2, None, 5), (1, 2, "x", 6)], "a long, b long, eq string, n int")
    got = rows.select(routing.key_field(key), routing.key_text(key)).collect()
    assert [tuple(r) for r in got] == [("b", "2"), ("b", "2"), ("a", "1")]
    plain = spec.ShardKey(field="a", rules=key.rules)
    assert {r[0] for r in rows.select(routing.key_field(plain)).collect()} == {"a"}


def test_null_key_fails_and_missing_field_fails(spark):
    rows = spark.createDataFrame([(None,)], "o_orderkey long")
    with pytest.raises(PySparkException):
        routing.route(rows, pr.ORDERS, pr.V1, pr.V2).collect()
    with pytest.raises(PySparkException):
        routing.route(spark.range(1), pr.ORDERS, pr.V1, pr.V2)


def test_algorithm_names():
    assert spec.algorithm(" ketama ") == spec.algorithm("") == spec.algorithm(None) == spec.KETAMA
    assert spec.algorithm("hash_mod") == spec.HASH_MOD
    with pytest.raises(ValueError):
        spec.algorithm("md5")


# ---- scan


def rows_with_ties(spark, n=540):
    rng = random.Random(5)
    return spark.createDataFrame([(i, at(0, rng.randrange(60))) for i in range(n)], "id long, at timestamp_ntz")


def test_pages_equal_the_whole_scan(spark):
    df = rows_with_ties(spark)
    whole = [tuple(r) for r in scan.range_scan(df, "at", "id", at(0), at(1)).collect()]
    cursor, got, steps = scan.Cursor(), [], 0
    while True:
        page = scan.read_page(df, "at", "id", at(0), at(1), cursor, 100)
        got += [tuple(r) for r in page.rows.collect()]
        cursor, steps = page.cursor, steps + 1
        if page.exhausted:
            break
    assert got == whole and steps == 6


def test_empty_page_moves_to_the_end_and_range_is_half_open(spark):
    df = rows_with_ties(spark, 5)
    page = scan.read_page(df, "at", "id", at(5), at(6), scan.Cursor(at(5), 9), 10)
    assert (page.n, page.cursor, page.exhausted) == (0, scan.Cursor(at(6), 9), True)
    edge = spark.createDataFrame([(1, at(0)), (2, at(1)), (3, None)], "id long, at timestamp_ntz")
    assert [r.id for r in scan.range_scan(edge, "at", "id", at(0), at(1)).collect()] == [1]
    assert [r.id for r in scan.unscanned(edge, "at").collect()] == [3]


def test_cursor_reaches_the_scan(spark, sf):
    df = scan.range_scan(spark.read.parquet(f"{sf}/orders.parquet"), "o_orderdate", "o_orderkey", pr.SCAN_FROM, pr.SCAN_TO, scan.Cursor(pr.AFTER_AT, pr.AFTER_ID), 10)
    plan = df._jdf.queryExecution().toString()
    pushed = plan[plan.index("PushedFilters") :]
    assert "GreaterThanOrEqual(o_orderdate" in pushed and "Or(" in pushed and "LessThan(o_orderdate" in pushed
    assert "TakeOrderedAndProject" in plan


# ---- ledger


def routed_rows(spark, rows):
    df = spark.createDataFrame(rows, "id long, op_id string, payload string, target_db string")
    return df.withColumns({"key_field": F.lit("op_id"), "key_value": F.col("op_id")}).withColumns(ledger.ledger_key("m1", "orders"))


def test_commit_is_once_only_and_repeatable(spark, tmp_path):
    data, book = f"file://{tmp_path}/data", f"file://{tmp_path}/ledger"
    order = [F.col("id")]
    first = routed_rows(spark, [(42, "k1", "a", "db3"), (42, "k2", "b", "db3"), (43, "k2", "late", "db4")])
    ledger.commit(first, 0, data, book, "id", order)
    ledger.commit(first, 0, data, book, "id", order)  # the same batch again
    ledger.commit(routed_rows(spark, [(99, "k1", "again", "db3"), (100, "k3", "c", "db4")]), 1, data, book, "id", order)
    got = sorted((r.op_id, r.payload, r.target_db) for r in incremental.transferred(spark, data, book).collect())
    assert got == [("k1", "a", "db3"), ("k2", "b", "db3"), ("k3", "c", "db4")]
    assert spark.read.parquet(book).count() == 3
    assert "id" not in spark.read.parquet(data).columns


def test_data_without_ledger_entry_does_not_show(spark, tmp_path):
    data, book = f"file://{tmp_path}/data", f"file://{tmp_path}/ledger"
    ledger.commit(routed_rows(spark, [(1, "k1", "a", "db3")]), 0, data, book, "id", [F.col("id")])
    routed_rows(spark, [(2, "k2", "b", "db3")]).drop("id").write.partitionBy("target_db").parquet(f"{data}/writer=only/batch_id=1")  # broke off here
    assert [r.op_id for r in incremental.transferred(spark, data, book).collect()] == ["k1"]
    ledger.commit(routed_rows(spark, [(2, "k2", "b", "db3")]), 1, data, book, "id", [F.col("id")])
    assert sorted(r.op_id for r in incremental.transferred(spark, data, book).collect()) == ["k1", "k2"]


def test_ledger_tells_fields_apart_and_matches_number_with_text(spark):
    rows = routed_rows(spark, [(1, "5", "a", "db3")])
    other = rows.withColumn("shard_key_field", F.lit("mb_uid"))
    assert ledger.not_in_ledger(rows, other).count() == 1
    assert ledger.not_in_ledger(rows, rows).count() == 0
    assert ledger.not_in_ledger(rows, rows.withColumn("migration_id", F.lit("m0"))).count() == 1


def test_insert_drops_the_id_by_exact_name(spark):
    df = spark.createDataFrame([(1, 2)], "ID long, x long")
    assert ledger.insert_rows(df, "id").columns == ["ID", "x"]
    assert ledger.insert_rows(df, "ID").columns == ["x"]


# ---- planning and progress

TASK = "task_id string, table_name string, source_db string, range_from timestamp_ntz, range_to timestamp_ntz, status string, generation long, sequence_number int, batch_size int"


def task(spark, *rows):
    return spark.createDataFrame([(f"t{i}", "orders", d, a, b, s, g, i + 1, 0) for i, (d, a, b, s, g) in enumerate(rows)], TASK)


def points(spark, *rows):
    return spark.createDataFrame(list(rows), "table_name string, source_db string, position timestamp_ntz")


def plan(spark, tasks, checkpoints, end, free=9):
    scopes = spark.createDataFrame([("orders", "db1"), ("orders", "db2")], "table_name string, source_db string")
    starts = planner.next_start(scopes, checkpoints, tasks, scan.timestamp(T0))
    return [tuple(r) for r in planner.plan_next(starts, scan.timestamp(end), 60, free, 0, ["source_db"]).select("source_db", "range_from", "range_to", "task_id").collect()]


def test_planner_scenarios(spark):
    none, no_points = task(spark).limit(0), points(spark).limit(0)
    assert plan(spark, none, no_points, at(24))[0] == ("db1", at(0), at(1), "task-orders-db1-20240101T000000")
    assert len(plan(spark, none, no_points, at(24), 1)) == 1 and plan(spark, none, no_points, at(24), 0) == []
    assert plan(spark, none, points(spark, ("orders", "db1", at(5))), at(24))[0][1:3] == (at(5), at(6))
    assert plan(spark, task(spark, ("db1", at(0), at(1), "RUNNING", 1)), no_points, at(24))[0][1] == at(1)
    assert [r[0] for r in plan(spark, none, points(spark, ("orders", "db1", at(24))), at(24))] == ["db2"]
    assert plan(spark, none, points(spark, ("orders", "db1", at(23, 40))), at(24))[0][2] == at(24)


def walk(start, ranges):
    position = start
    for a, b in sorted(r for r in ranges if r[1] > start):
        if a != position:
            break
        position = b
    return position


def test_prefix_equals_a_walk(spark):
    rng = random.Random(11)
    rows, marks, expected = [], [], {}
    for i in range(60):
        d = f"s{i}"
        hours = sorted(rng.sample(range(12), rng.randrange(1, 10)))
        start = at(rng.randrange(4))
        rows += [(d, at(h), at(h + 1), "COMPLETED", 1) for h in hours]
        if rng.random() < 0.7:
            marks.append(("orders", d, start))
        else:
            start = T0
        expected[d] = walk(start, [(at(h), at(h + 1)) for h in hours])
    got = progress.checkpoint_prefix(task(spark, *rows), points(spark, *marks), scan.timestamp(T0))
    assert {r.source_db: r.position for r in got.collect()} == expected


def test_batch_sizes(spark):
    rows = task(spark, ("db1", at(0), at(1), "RUNNING", 2), ("db1", at(0), at(1), "RUNNING", 1), ("db9", at(0), at(1), "RUNNING", 1))
    current, target = F.array(F.lit("db1"), F.lit("db2")), F.array(*[F.lit(f"db{i}") for i in range(1, 5)])
    sized = planner.batch_sizes(rows, 50_000, 500, 10, current, F.lit(False))
    assert [(r.read_size, r.write_size) for r in sized.orderBy("task_id").collect()] == [(500, 500), (5000, 50000), (50000, 50000)]
    to = planner.target_sizes(sized.where("task_id = 't1'").withColumn("target_db", F.explode(F.array(F.lit("db2"), F.lit("db3")))), 10, current, target)
    assert {r.target_db: (r.write_size, r.insert_mode) for r in to.collect()} == {"db2": (5000, "ROW_INSERT"), "db3": (50000, "COPY")}
    assert {r.insert_mode for r in planner.batch_sizes(rows, 50_000, 500, 10, current, F.lit(True)).collect()} == {"IDEMPOTENT_INSERT"}


def test_bulk_complete_edges(spark):
    shards = spark.createDataFrame([("db1",)], "source_db string")
    off = spark.createDataFrame([("orders", False)], "table_name string, enabled boolean")
    on = off.withColumn("enabled", F.lit(True))
    done = lambda t, s, p, e: progress.bulk_complete(t, s, p, e).first()[0]
    end, empty = scan.timestamp(at(2)), points(spark).limit(0)
    assert done(off, shards, empty, end) is True
    assert done(on, shards, empty, end) is False
    assert done(on, shards, points(spark, ("orders", "db1", at(2))), end) is True
    assert done(on, shards.limit(0), empty, end) is False
    assert done(on, shards, points(spark, ("orders", "db1", at(2))), F.lit(None).cast("timestamp_ntz")) is False


def test_months(spark):
    rows = spark.createDataFrame([("a", at(743), at(744)), ("b", at(0), at(300)), ("c", None, at(744)), ("d", at(340), datetime(2024, 4, 1))], "k string, x timestamp_ntz, y timestamp_ntz")
    got = sorted((r.k, r.month) for r in progress.crossed_months(rows, "x", "y").collect())
    assert got == [("a", "2024-01"), ("d", "2024-01"), ("d", "2024-02"), ("d", "2024-03")]


# ---- names, state, validation


def test_names(spark):
    row = spark.range(1)
    long = "idx_orders_" + "very_long_partition_name_" * 4 + "_verify_created_at"
    name = row.select(naming.index_name(F.lit(long))).first()[0]
    assert len(name) == 63 and name == "idx_orders_very_long_partition_name_very_long_part_ff1a03a9a8e3"
    assert row.select(naming.quote_qualified(F.lit("public.users"))).first()[0] == '"public"."users"'
    with pytest.raises(PySparkException):
        row.select(naming.quote(F.lit('x"; DROP'))).collect()
    assert row.select(naming.partition_name(F.lit("orders"), scan.timestamp(T0))).first()[0] == "orders_2024_01"


def test_commands():
    assert state.command("START", None) == ("RUNNING", None)
    assert state.command("START", "RUNNING")[1] and state.command("START", "STOPPED")[1]
    assert state.command("STOP", "RUNNING") == ("STOPPED", None) and state.command("STOP", None)[1]
    assert state.command("RESUME", "STOPPED") == ("RUNNING", None) and state.command("RESUME", "RUNNING")[1]


def test_start_validation():
    assert "required" in spec.start_error(None, at(1), ())
    assert "strictly before" in spec.start_error(at(1), at(1), ())
    assert "unique" in spec.start_error(at(0), at(1), (pr.ORDERS_BY_RULE,))
    assert spec.start_error(at(0), at(1), (pr.ORDERS,)) is None


def test_configuration():
    tables = spec.tables_from({"orders": {"enabled": True, "shardKey": {"defaultField": "op_id", "unique": True, "rules": [{"whenField": "eq", "whenValue": "b12", "useField": "mb_uid"}]}}, "events": {"shardKey": {"field": "client_id"}}})
    assert tables[0].required_columns() == ["created_at", "id", "op_id", "eq", "mb_uid"]
    assert tables[0].algorithm == spec.KETAMA and not tables[1].enabled and tables[1].table == "events"
    tops = spec.topologies_from({"a": {"ketamaServer": " "}, "b": {"ketamaWeight": 0}}, {"v1": {"shards": ["a", "b"]}})
    assert [s.ring_server for s in tops["v1"].shards] == ["a", "b"] and tops["v1"].shards[1].ring_weight == 1


def test_state_store(spark, tmp_path):
    store = StateStore(spark, f"file://{tmp_path}/kv")
    assert store.put_if_absent("a/1", "x") and not store.put_if_absent("a/1", "y")
    r = store.get("a/1").revision
    assert store.compare_and_set("a/1", "z", r) and not store.compare_and_set("a/1", "late", r)
    store.put("a/2", "w")
    store.put("b/1", "v")
    assert [k for k, _ in store.prefix("a/")] == ["a/1", "a/2"]
    assert not store.compare_and_delete("a/1", r) and store.compare_and_delete("a/1", store.get("a/1").revision)
    assert store.delete_prefix("a/") and not store.exists("a/2") and store.exists("b/1")
    assert [tuple(x)[:2] for x in store.table().collect()] == [("b/1", "v")]


def test_stream_equals_batch_over_several_runs(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet")
    files = f"file://{tmp_path}/in"
    args = ("m1", pr.EVENTS, pr.V1, pr.V2, f"file://{tmp_path}/data", f"file://{tmp_path}/ledger", f"file://{tmp_path}/cp", [F.col("ts"), F.col("event_id")])
    for part in range(3):
        events.where(F.col("event_id") % 3 == part).coalesce(1).write.mode("append").parquet(files)
        q = incremental.run(incremental.arrivals(spark, files, events.schema), *args)
        q.awaitTermination()
        assert incremental.caught_up(q)
    keys = routing.moved(routing.route(events, pr.EVENTS, pr.V1, pr.V2)).select("key_value").distinct().count()
    done = incremental.transferred(spark, args[4], args[5])
    assert done.count() == done.select("shard_key_value").distinct().count() == keys


# ---- whole moves


def bulk(spark, sf, path, ident="m1"):
    from shardloom.engine import BulkMove

    events = spec.TableSpec("events", pr.EVENTS.shard_key, range_column="ts", id_column="event_id")
    move = spec.Move(ident, pr.V1, pr.V2, datetime(1995, 1, 1), datetime(2025, 1, 1), (pr.ORDERS, events))
    return BulkMove(spark, move, {"orders": spark.read.parquet(f"{sf}/orders.parquet"), "events": spark.read.parquet(f"{sf}/events.parquet")}, path)


def test_bulk_move(spark, sf, tmp_path):
    job = bulk(spark, sf, f"file://{tmp_path}/out")
    report = {(r.table_name, r.source_db, r.target_db): r.n_rows for r in job.run().collect()}
    assert job.complete() and not job.state.exists(job.LOCK)
    matrix = routing.moved(routing.route(spark.read.parquet(f"{sf}/orders.parquet"), pr.ORDERS, pr.V1, pr.V2)).groupBy("source_db", "target_db").count().collect()
    assert {k[1:]: n for k, n in report.items() if k[0] == "orders"} == {(r[0], r[1]): r[2] for r in matrix}
    keys = routing.moved(routing.route(spark.read.parquet(f"{sf}/events.parquet"), pr.EVENTS, pr.V1, pr.V2)).select("key_value").distinct().count()
    assert sum(n for k, n in report.items() if k[0] == "events") == keys  # the first of a key wins
    again = {(r.table_name, r.source_db, r.target_db): r.n_rows for r in bulk(spark, sf, f"file://{tmp_path}/out").run().collect()}
    assert again == report


def test_bulk_move_goes_on_after_a_break(spark, sf, tmp_path, monkeypatch):
    import shardloom.engine as engine

    whole = bulk(spark, sf, f"file://{tmp_path}/whole")
    expected = sorted(map(tuple, whole.run().collect()))
    job, honest, calls = bulk(spark, sf, f"file://{tmp_path}/out"), engine.commit, []

    def breaks(*args):
        calls.append(args[6])
        if len(calls) == 3:
            raise RuntimeError("lost")
        honest(*args)

    monkeypatch.setattr(engine, "commit", breaks)
    with pytest.raises(RuntimeError, match="lost"):
        job.run()
    assert not job.complete()
    with pytest.raises(RuntimeError, match="under way"):
        bulk(spark, sf, f"file://{tmp_path}/out", "other").start()
    again = bulk(spark, sf, f"file://{tmp_path}/out")
    assert sorted(map(tuple, again.run().collect())) == expected
    assert again.complete() and again.status() == "COMPLETED" and not again.state.exists(again.LOCK)
    # only the range that broke off was run twice
    assert len(calls) == 9 and len(set(calls)) == 8 and calls.count(calls[2]) == 2


def test_stop_resume_and_status(spark, sf, tmp_path):
    expected = sorted(map(tuple, bulk(spark, sf, f"file://{tmp_path}/whole").run().collect()))
    job = bulk(spark, sf, f"file://{tmp_path}/out")
    assert job.status() is None
    with pytest.raises(RuntimeError):
        job.stop()
    job.run(waves=1)
    assert job.status() == "RUNNING" and job.checkpoints().count() == 2 and not job.complete()
    job.stop()
    with pytest.raises(RuntimeError, match="resumed"):
        job.run()
    again = bulk(spark, sf, f"file://{tmp_path}/out")
    assert sorted(map(tuple, again.resume().collect())) == expected
    assert again.status() == "COMPLETED" and job.tasks().count() == 0


def test_a_lock_runs_out(spark, sf, tmp_path):
    path, now = f"file://{tmp_path}/out", [datetime(2024, 1, 1)]
    first, second = (bulk(spark, sf, path, i) for i in ("m1", "m2"))
    first.clock = second.clock = lambda: now[0]
    first.start()
    with pytest.raises(RuntimeError):
        second.start()
    now[0] += timedelta(minutes=11)
    second.start()
    with pytest.raises(RuntimeError):
        first.start()


def test_a_late_worker_cannot_complete(spark, sf, tmp_path):
    first, second = (bulk(spark, sf, f"file://{tmp_path}/out") for _ in range(2))
    first.start()
    first._plan()
    held = first._claim()
    second._release()
    (taken, *_) = [t for t in second._claim() if t["task_id"] == held[0]["task_id"]]
    assert taken["generation"] == 2 and taken["claim_token"] == second.token != held[0]["claim_token"]
    with pytest.raises(RuntimeError, match="another"):
        first._complete(held[0])
    second._complete(taken)


def test_writers_on_one_path_keep_each_others_rows(spark, sf, tmp_path, monkeypatch):
    """Bulk, stream and a second move; each one's batch breaks off between data and ledger and is run again."""
    orders = spark.read.parquet(f"{sf}/orders.parquet")
    routed = routing.moved(routing.route(orders, pr.ORDERS, pr.V1, pr.V2)).withColumns(ledger.ledger_key("m1", "orders"))
    data, book, order = f"file://{tmp_path}/data", f"file://{tmp_path}/ledger", [F.col("o_orderkey")]
    parts = [("m1.bulk", routed.where("o_orderkey % 3 = 0")), ("m1.stream", routed.where("o_orderkey % 3 < 2")), ("m2.bulk", routed.withColumn("migration_id", F.lit("m2")))]
    honest = ledger.insert_rows
    for writer, rows in parts:
        broken = []

        def breaks(df, name, broken=broken):
            if not broken:
                broken.append(1)
                honest(df, name).limit(5).write.mode("overwrite").partitionBy("target_db").parquet(ledger._folder(data, writer, 0))
                raise RuntimeError("lost")
            return honest(df, name)

        monkeypatch.setattr(ledger, "insert_rows", breaks)
        with pytest.raises(RuntimeError):
            ledger.commit(rows, 0, data, book, "o_orderkey", order, writer)
        ledger.commit(rows, 0, data, book, "o_orderkey", order, writer)
    got = incremental.transferred(spark, data, book).groupBy("migration_id").agg(F.count("*"), F.countDistinct("shard_key_value"))
    n = {r[0]: r[1:] for r in got.collect()}
    assert n["m1"] == (routed.where("o_orderkey % 3 < 2").count(),) * 2 and n["m2"] == (routed.count(),) * 2


def test_sharded_sources(spark, sf, tmp_path):
    """A table given shard by shard: a scope each, and the same rows."""
    job = bulk(spark, sf, f"file://{tmp_path}/out")
    expected = sorted(map(tuple, job.run().collect()))
    by_shard = lambda df, spec: {s: routing.route(df, spec, pr.V1, pr.V2).where(F.col("source_db") == s).drop("source_db", "target_db", "key_field", "key_value") for s in pr.V1.ids}
    other = bulk(spark, sf, f"file://{tmp_path}/by_shard")
    other.sources = {"orders": by_shard(job.sources["orders"], pr.ORDERS), "events": by_shard(job.sources["events"], pr.EVENTS)}
    assert sorted(map(tuple, other.run().collect())) == expected and other.checkpoints().count() == 4


# ---- databases


def test_jdbc(spark, sf, tmp_path):
    """Read and write against an embedded database, quoted names and a retry included."""
    from shardloom.sources import shards

    url = lambda n: f"jdbc:derby:memory:{tmp_path.name}_{n};create=true"
    source = spec.Shard("db1", url=url("s"))
    shards.execute(spark, source.url, ['CREATE TABLE "ord" ("id" BIGINT, "order" VARCHAR(40), "at" TIMESTAMP)'])
    shards.execute(spark, source.url, [f"INSERT INTO \"ord\" VALUES ({i}, 'k{i // 2}', {{ts '2024-01-01 {i % 24:02d}:00:00'}})" for i in range(40)])
    read = shards.read_jdbc(spark, source, "ord", "at", [(datetime(2024, 1, 1, h), datetime(2024, 1, 1, h + 6)) for h in (0, 6, 12)])
    assert read.rdd.getNumPartitions() == 3 and sorted(r.id for r in read.collect()) == [i for i in range(40) if i % 24 < 18]
    with pytest.raises(ValueError):
        shards.read_jdbc(spark, source, "ord", 'at" OR 1=1 --', [(datetime(2024, 1, 1), datetime(2024, 1, 2))])

    targets = [spec.Shard(f"db{i}", url=url(f"t{i}")) for i in (3, 4, 5)]
    for t in targets:
        shards.execute(spark, t.url, ['CREATE TABLE "ord" ("order" VARCHAR(40), "at" TIMESTAMP)'])
    first = ledger.first_wins(read.withColumns({"key_field": F.lit("order"), "key_value": F.col("order")}).withColumns(ledger.ledger_key("m1", "ord")), ledger.KEY, [F.col("id")])
    rows = first.withColumn("target_db", F.when(F.col("id") % 4 == 0, "db3").otherwise("db4"))
    n = shards.write_jdbc(rows, targets, "ord", "task-1", "id")
    assert sum(n.values()) == rows.count() and n["db5"] == 0
    assert shards.write_jdbc(rows, targets, "ord", "task-1", "id") == {"db3": 0, "db4": 0, "db5": 0}  # the same task again
    more = rows.unionByName(rows.limit(1).withColumns({"order": F.lit("new"), "shard_key_value": F.lit("new"), "target_db": F.lit("db3")}))
    assert shards.write_jdbc(more, targets, "ord", "task-2", "id")["db3"] == 1
    held = [r for t in targets for r in spark.read.jdbc(t.url, '"ord"').collect()]
    assert sorted(r.order for r in held) == sorted([r.order for r in rows.collect()] + ["new"])
    # a transaction that fails leaves nothing
    with pytest.raises(Exception):
        shards.execute(spark, targets[0].url, ['DELETE FROM "ord"', 'DELETE FROM "no_such"'])
    assert spark.read.jdbc(targets[0].url, '"ord"').count() == n["db3"] + 1


def test_move_id():
    from shardloom.engine import move_id

    assert move_id(T0).startswith("mig-20240101-") and len(move_id(T0)) == 25
