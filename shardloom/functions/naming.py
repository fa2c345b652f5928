"""Names as column expressions: identifiers, partitions, indexes, tasks and state keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What an identifier may be, how long, and the parts of a shortened name.
IDENTIFIER = r"^[A-Za-z_][A-Za-z0-9_$]*$"
MOST_BYTES, HASH_DIGITS = 63, 12
CREATE_INDEX = "CREATE INDEX IF NOT EXISTS "


def quote(name: Column) -> Column:
    """A valid identifier in double quotes; any other is an error."""
    return F.when(name.rlike(IDENTIFIER), F.concat(F.lit('"'), name, F.lit('"'))).otherwise(F.raise_error(F.concat(F.lit("Unsafe SQL identifier: "), F.coalesce(name, F.lit("null")))).cast("string"))


def quote_qualified(name: Column) -> Column:
    return F.array_join(F.transform(F.split(name, r"\."), quote), ".")


def index_name(wanted: Column) -> Column:
    """A name of at most 63 bytes; a longer one ends in a digest of the whole."""
    safe = F.regexp_replace(wanted, r"[^A-Za-z0-9_$]", "_")
    short = F.concat(F.substring(safe, 1, MOST_BYTES - HASH_DIGITS - 1), F.lit("_"), F.substring(F.sha2(safe, 256), 1, HASH_DIGITS))
    return F.when(F.octet_length(safe) <= MOST_BYTES, safe).otherwise(short)


def index_statements(table: Column, date_column: Column, id_column: Column | None) -> Column:
    """The index on the date, and the one on date and id if an id is given."""
    plain = F.concat(F.lit(CREATE_INDEX), quote(index_name(F.concat_ws("_", F.lit("idx"), table, F.lit("verify"), date_column))), F.lit(" ON "), quote_qualified(table), F.lit(" ("), quote(date_column), F.lit(")"))
    if id_column is None:
        return F.array(plain)
    both = F.concat(F.lit(CREATE_INDEX), quote(index_name(F.concat_ws("_", F.lit("idx"), table, F.lit("verify"), date_column, id_column))), F.lit(" ON "), quote_qualified(table), F.lit(" ("), quote(date_column), F.lit(", "), quote(id_column), F.lit(")"))
    return F.array(plain, both)


def index_of(statement: Column) -> Column:
    """The index's name in a CREATE INDEX statement."""
    return F.replace(F.trim(F.regexp_extract(statement, r"IF NOT EXISTS(.*?) ON ", 1)), F.lit('"'), F.lit(""))


def month_key(at: Column) -> Column:
    return F.date_format(at, "yyyy-MM")


def partition_name(table: Column, month: Column, pattern: str = "") -> Column:
    out = F.lit(pattern.strip() or "{table}_{yyyy}_{MM}")
    for mark, value in (("{table}", table), ("{yyyy}", F.date_format(month, "yyyy")), ("{MM}", F.date_format(month, "MM"))):
        out = F.replace(out, F.lit(mark), value)
    return out


def task_id(table: Column, shard: Column, start: Column) -> Column:
    return F.concat_ws("-", F.lit("task"), table, shard, F.date_format(start, "yyyyMMdd'T'HHmmss"))


def state_key(prefix: str, *parts: Column | str) -> Column:
    """A path in the state store below a prefix, which may end in a slash."""
    return F.concat_ws("/", F.lit(prefix[:-1] if prefix.endswith("/") else prefix), *[F.lit(p) if isinstance(p, str) else p for p in parts])
