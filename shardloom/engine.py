"""A whole bulk move: validated, planned by range, claimed, read, routed, committed through the ledger, and checkpointed.

The plan's tables are kept in the state store: tasks (a range of a table's
source), checkpoints, and the move's status. A wave plans each scope's next
range, claims what is claimable, runs the claimed ranges as Spark jobs side by
side, and advances the checkpoints over what is complete without a gap. A task
is a batch of the ledger's, so it is whole or repeatable: a move that was
stopped or broke off in the middle of a table goes on from its last range.

A range is one distributed job, not one page: ``ranges`` says how many a scope's
span is cut into, and a range is never shorter than the move's limit.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Mapping
from concurrent.futures import ThreadPoolExecutor
from datetime import UTC, datetime, timedelta
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators.ledger import commit, ledger_key, transferred
from .operators.routing import moved, route
from .operators.scan import in_range, order, timestamp
from .plans import planner, progress
from .plans.state import command
from .sources.state_store import StateStore
from .spec import Move, TableSpec

TASKS = "task_id string, table_name string, source_db string, range_from timestamp_ntz, range_to timestamp_ntz, status string, generation long, sequence_number int, claim_token string, worker_id string"
POINTS = "table_name string, source_db string, position timestamp_ntz"
#: The scope of a table whose rows come as one frame, whatever shards they lie in.
WHOLE = "all"


def move_id(now: datetime) -> str:
    """A new move's id: its day and part of a random UUID."""
    return f"mig-{now:%Y%m%d}-{str(uuid4())[:12]}"


class BulkMove:
    """paths: ``data`` (rows by table and target shard), ``ledger`` and ``state`` below ``path``.

    sources: of each table its rows, or its rows by source shard. The lock is
    held for ``lease`` and renewed with every wave; one that has run out can be
    taken, and so can the same move's.
    """

    LOCK = "migration/active-lock"

    def __init__(self, spark: SparkSession, move: Move, sources: Mapping[str, DataFrame | Mapping[str, DataFrame]], path: str, ranges: int = 4, lease: timedelta = timedelta(minutes=10), clock: Callable[[], datetime] = lambda: datetime.now(UTC)):
        self.spark, self.move, self.sources, self.path = spark, move, sources, path.rstrip("/")
        self.state, self.lease, self.clock, self.token = StateStore(spark, f"{self.path}/state"), lease, clock, uuid4().hex
        self.key = f"migration/{move.id}"
        span = (move.end - move.start).total_seconds() / 60 if move.start and move.end else 0
        self.minutes = max(move.limits.range_minutes, math.ceil(span / max(1, ranges)))

    # ---- the move's state

    def status(self) -> str | None:
        held = self.state.get(f"{self.key}/status")
        return held and held.value

    def _command(self, what: str) -> None:
        after, why = command(what, self.status())
        if why:
            raise RuntimeError(why)
        self._write({f"{self.key}/status": after})

    def _write(self, values: dict[str, str]) -> None:
        for _ in range(8):  # another writer may be first
            if self.state.put_all(values):
                return
        raise RuntimeError("the state could not be written")

    def _lock(self) -> None:
        until = json.dumps([self.move.id, (self.clock() + self.lease).isoformat()])
        for _ in range(8):
            held = self.state.get(self.LOCK)
            if held is None:
                if self.state.put_if_absent(self.LOCK, until):
                    return
                continue
            owner, runs_out = json.loads(held.value)
            if owner != self.move.id and datetime.fromisoformat(runs_out) > self.clock():
                raise RuntimeError("another move is under way")
            if self.state.compare_and_set(self.LOCK, until, held.revision):
                return
        raise RuntimeError("the lock could not be taken")

    def start(self) -> None:
        """Validate, take the lock, and set the move running; no source is touched. Starting a move that broke off is taking it up again."""
        if why := self.move.error():
            raise ValueError(why)
        self._lock()
        if self.status() != "RUNNING":
            self._command("START")

    def stop(self) -> None:
        """The present wave is the last. From any application: only the state is written."""
        self._command("STOP")

    def resume(self) -> DataFrame:
        """Go on with a stopped move, and report."""
        self._lock()
        self._command("RESUME")
        return self._work()

    # ---- plans

    def _scopes(self) -> list[tuple[TableSpec, str, DataFrame]]:
        out = []
        for table in self.move.enabled():
            rows = self.sources[table.key]
            out += [(table, shard, df) for shard, df in (rows.items() if isinstance(rows, Mapping) else [(WHOLE, rows)])]
        return out

    def tasks(self) -> DataFrame:
        """The tasks that no checkpoint covers yet."""
        rows = [json.loads(e.value) for _, e in self.state.prefix(f"{self.key}/tasks/")]
        times = lambda t: t | {k: datetime.fromisoformat(t[k]) for k in ("range_from", "range_to")}
        names = [c.split()[0] for c in TASKS.split(", ")]
        return self.spark.createDataFrame([tuple(times(t)[n] for n in names) for t in rows], TASKS)

    def checkpoints(self) -> DataFrame:
        rows = [(*json.loads(e.value)[:2], datetime.fromisoformat(json.loads(e.value)[2])) for _, e in self.state.prefix(f"{self.key}/checkpoints/")]
        return self.spark.createDataFrame(rows, POINTS)

    def _save(self, tasks: DataFrame) -> list[dict]:
        rows = [r.asDict() | {"range_from": r.range_from.isoformat(), "range_to": r.range_to.isoformat()} for r in tasks.collect()]  # a row a scope
        if rows:
            self._write({f"{self.key}/tasks/{t['task_id']}": json.dumps(t) for t in rows})
        return rows

    def _plan(self) -> None:
        scopes = self.spark.createDataFrame([(t.table, s) for t, s, _ in self._scopes()], "table_name string, source_db string")
        tasks = self.tasks()
        starts = planner.next_start(scopes, self.checkpoints(), tasks, timestamp(self.move.start))
        new = planner.plan_next(starts, timestamp(self.move.end), self.minutes, self.move.limits.concurrent, planner.last_sequence(tasks), ["next_from", "table_name", "source_db"])
        self._save(new.withColumns({"claim_token": F.lit(None).cast("string"), "worker_id": F.lit(None).cast("string")}))

    def _claim(self) -> list[dict]:
        claimed = planner.claim_next(self.tasks(), self.move.limits.concurrent)
        return self._save(claimed.withColumns({"status": F.lit("RUNNING"), "claim_token": F.lit(self.token), "worker_id": F.lit(self.token)}))

    def _release(self) -> None:
        """Tasks of a run that broke off: the lock is ours, so nobody else has them."""
        self._save(progress.stale(self.tasks(), self.spark.createDataFrame([], "task_id string")))

    def _advance(self) -> None:
        done = self.tasks().where("status = 'COMPLETED'")
        reach = progress.checkpoint_prefix(done, self.checkpoints(), timestamp(self.move.start)).collect()  # a row a scope
        if reach:
            self._write({f"{self.key}/checkpoints/{r.table_name}/{r.source_db}": json.dumps([r.table_name, r.source_db, r.position.isoformat()]) for r in reach})
        for r in progress.covered(done, self.checkpoints()).select("task_id").collect():
            self.state.delete(f"{self.key}/tasks/{r.task_id}")

    # ---- work

    def _paths(self, table: str) -> tuple[str, str]:
        return f"{self.path}/data/{table}", f"{self.path}/ledger/{table}"

    def routed(self, table: TableSpec, rows: DataFrame, start: datetime, end: datetime) -> DataFrame:
        """A source's rows of a range that change their shard, with their ledger key."""
        return moved(route(rows.where(in_range(table.range_column, start, end)), table, self.move.current, self.move.target)).withColumns(ledger_key(self.move.id, table.table))

    def _execute(self, task: dict) -> None:
        table, _, rows = next(s for s in self._scopes() if (s[0].table, s[1]) == (task["table_name"], task["source_db"]))
        data, ledger = self._paths(table.table)
        rows = self.routed(table, rows, datetime.fromisoformat(task["range_from"]), datetime.fromisoformat(task["range_to"]))
        commit(rows, task["sequence_number"], data, ledger, table.id_column, [*order(table.range_column, table.id_column), F.col("source_db")], f"{self.move.id}.{task['task_id']}")

    def _complete(self, task: dict) -> None:
        """Fenced: only the claim's holder, by generation and token, completes a task."""
        at = f"{self.key}/tasks/{task['task_id']}"
        for _ in range(8):
            held = self.state.get(at)
            if held is None or [json.loads(held.value)[k] for k in ("generation", "claim_token")] != [task["generation"], task["claim_token"]]:
                raise RuntimeError("the task was claimed by another")
            if self.state.compare_and_set(at, json.dumps(task | {"status": "COMPLETED"}), held.revision):
                return
        raise RuntimeError("the state could not be written")

    def _work(self, waves: int | None = None) -> DataFrame:
        self._release()
        while self.status() == "RUNNING" and (waves is None or waves > 0):
            self._lock()
            self._plan()
            tasks = self._claim()
            if not tasks:
                break
            with ThreadPoolExecutor(len(tasks)) as pool:
                running = [pool.submit(self._execute, t) for t in tasks]
            failed = [r.exception() for r in running]
            for task, why in zip(tasks, failed, strict=True):
                if why is None:
                    self._complete(task)
            self._advance()
            if why := next(filter(None, failed), None):
                raise why
            waves = None if waves is None else waves - 1
        if self.status() == "RUNNING" and self.complete():
            self._write({f"{self.key}/status": "COMPLETED"})
        if self.status() != "RUNNING":
            self.state.delete(self.LOCK)
        return self.report()

    def run(self, waves: int | None = None) -> DataFrame:
        """Move every enabled table, or so many waves of them, then report (table, source, target, rows)."""
        self.start()
        return self._work(waves)

    def report(self) -> DataFrame:
        out = None
        for table, rows in {t.table: (t, rows) for t, _, rows in self._scopes()}.values():
            schema = self.routed(table, rows, self.move.start, self.move.end).drop(table.id_column).schema
            mine = transferred(self.spark, *self._paths(table.table), schema).where(F.col("migration_id") == self.move.id)
            found = mine.groupBy("source_db", "target_db").agg(F.count("*").alias("n_rows")).select(F.lit(table.table).alias("table_name"), "source_db", "target_db", "n_rows")
            out = found if out is None else out.unionByName(found)
        return out

    def complete(self) -> bool:
        at = {tuple(json.loads(e.value)[:2]): datetime.fromisoformat(json.loads(e.value)[2]) for _, e in self.state.prefix(f"{self.key}/checkpoints/")}
        return all(at.get((t.table, s), self.move.start) >= self.move.end for t, s, _ in self._scopes())
