"""What a move of rows between shards is described by, and its validation. Plain values on the driver."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field
from datetime import datetime

KETAMA, HASH_MOD = "KETAMA", "HASH_MOD"
#: Ring points for each unit of a server's weight (fixed value).
POINTS = 160


def algorithm(text: str | None) -> str:
    """The name of a shard algorithm; blank is the ring."""
    name = (text or "").strip().upper() or KETAMA
    if name not in (KETAMA, HASH_MOD):
        raise ValueError(f"unknown shard algorithm: {text}")
    return name


@dataclass(frozen=True)
class Shard:
    id: str
    server: str = ""
    weight: int = 1
    url: str = ""
    source_slots: int = 2
    target_slots: int = 2

    @property
    def ring_server(self) -> str:
        return self.server.strip() or self.id

    @property
    def ring_weight(self) -> int:
        return self.weight if self.weight > 0 else 1


@dataclass(frozen=True)
class Topology:
    version: str
    shards: tuple[Shard, ...]
    points: int = POINTS

    @property
    def ids(self) -> list[str]:
        return [s.id for s in self.shards]


@dataclass(frozen=True)
class Rule:
    """Take ``use`` as the key where the text of ``when`` is ``value``."""

    when: str
    value: str
    use: str


@dataclass(frozen=True)
class ShardKey:
    """A plain field, or rules of which the first that fits wins, over a default."""

    field: str = ""
    default: str = ""
    rules: tuple[Rule, ...] = ()
    unique: bool = False

    def fields(self) -> list[str]:
        """Every column that choosing the key can read."""
        if self.field:
            return [self.field]
        return list(dict.fromkeys([self.default, *(c for r in self.rules for c in (r.when, r.use))]))


@dataclass(frozen=True)
class Partitioning:
    enabled: bool = False
    pattern: str = "{table}_{yyyy}_{MM}"
    index_when_complete: bool = True


@dataclass(frozen=True)
class TableSpec:
    key: str
    shard_key: ShardKey
    name: str = ""
    algorithm: str = KETAMA
    range_column: str = "created_at"
    id_column: str = "id"
    business_key: tuple[str, ...] = ()
    verify_columns: tuple[str, ...] = ()
    composite_index: bool = True
    batch_size: int = 0
    partition: Partitioning = Partitioning()
    enabled: bool = True

    @property
    def table(self) -> str:
        return self.name or self.key

    @property
    def date_columns(self) -> list[str]:
        return list(self.verify_columns) or [self.range_column]

    def required_columns(self) -> list[str]:
        return list(dict.fromkeys([self.range_column, self.id_column, *self.shard_key.fields(), *self.business_key]))


@dataclass(frozen=True)
class Limits:
    concurrent: int = 5
    copy_batch: int = 50_000
    idempotent_batch: int = 500
    active_divisor: int = 10
    range_minutes: int = 60


@dataclass(frozen=True)
class Move:
    """A move of the rows of some tables from one topology to another, over [start, end)."""

    id: str
    current: Topology
    target: Topology
    start: datetime
    end: datetime
    tables: tuple[TableSpec, ...]
    check_before_insert: bool = False
    limits: Limits = field(default_factory=Limits)

    def enabled(self) -> list[TableSpec]:
        return [t for t in self.tables if t.enabled]

    def error(self) -> str | None:
        return start_error(self.start, self.end, self.tables)


def start_error(start: datetime | None, end: datetime | None, tables: tuple[TableSpec, ...]) -> str | None:
    """Why a move can't start, or None."""
    if start is None or end is None:
        return "a move is required to have a first and a last date"
    if not start < end:
        return "the first date must lie strictly before the last"
    loose = next((t.key for t in tables if t.enabled and not t.shard_key.unique), None)
    return loose and f"the shard key of table {loose} isn't declared unique, and the ledger keeps one row a key"


def tables_from(config: Mapping) -> tuple[TableSpec, ...]:
    """Table specs from a parsed configuration's ``tables`` section."""
    out = []
    for key, t in config.items():
        k, p = t.get("shardKey") or {}, t.get("partition") or {}
        rules = tuple(Rule(r["whenField"], str(r["whenValue"]), r["useField"]) for r in k.get("rules", ()))
        out.append(
            TableSpec(
                key=key, name=t.get("tableName", ""), enabled=t.get("enabled", False), algorithm=algorithm(t.get("shardAlgorithm")),
                shard_key=ShardKey(k.get("field", ""), k.get("defaultField", ""), rules, k.get("unique", False)),
                range_column=t.get("rangeColumn", "created_at"), id_column=t.get("idColumn", "id"), business_key=tuple(t.get("businessKey", ())),
                verify_columns=tuple(t.get("verifyDateColumns", ())), composite_index=t.get("verifyCompositeWithId", True), batch_size=t.get("batchSize", 0),
                partition=Partitioning(p.get("enabled", False), p.get("namePattern") or Partitioning.pattern, p.get("indexAfterPartitionComplete", True)),
            )
        )
    return tuple(out)


def topologies_from(shards: Mapping, versions: Mapping, limits: Mapping | None = None) -> dict[str, Topology]:
    """Topologies by version from the sections of databases, topologies and database limits."""
    limits = limits or {}
    known = {
        k: Shard(k, s.get("ketamaServer", ""), s.get("ketamaWeight", 1), s.get("url", ""), (limits.get(k) or {}).get("maxSourceTasks", 2), (limits.get(k) or {}).get("maxTargetTasks", 2))
        for k, s in shards.items()
    }
    return {v: Topology(v, tuple(known[i] for i in t["shards"]), t.get("pointsPerServer") or POINTS) for v, t in versions.items()}
