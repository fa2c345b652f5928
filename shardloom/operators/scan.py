"""Range scans by keyset: half-open time ranges, cursors of (time, id), pages and their numbers."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Cursor:
    """The last row read. Reading continues after it only if both parts are known."""

    at: datetime | None = None
    id: int | None = None

    @property
    def known(self) -> bool:
        return self.at is not None and self.id is not None


@dataclass(frozen=True)
class Page:
    rows: DataFrame
    n: int
    cursor: Cursor
    exhausted: bool


def timestamp(at: datetime) -> Column:
    return F.lit(at.isoformat(sep=" ")).cast("timestamp_ntz")


def in_range(column: str, start: datetime, end: datetime) -> Column:
    """[start, end); a null time is in no range."""
    return (F.col(column) >= timestamp(start)) & (F.col(column) < timestamp(end))


def after(time: str, key: str, cursor: Cursor) -> Column:
    """(time, key) past the cursor, written so that every part reaches the scan."""
    t, i = F.col(time), F.col(key)
    at = timestamp(cursor.at)
    return (t >= at) & ((t > at) | ((t == at) & (i > F.lit(cursor.id))))


def order(time: str, key: str) -> list[Column]:
    return [F.col(time).asc_nulls_last(), F.col(key).asc_nulls_last()]


def range_scan(df: DataFrame, time: str, key: str, start: datetime, end: datetime, cursor: Cursor = Cursor(), limit: int | None = None) -> DataFrame:
    """Rows of the range in order: all after the cursor, if it is known, and at most ``limit``."""
    where = after(time, key, cursor) & (F.col(time) < timestamp(end)) if cursor.known else in_range(time, start, end)
    rows = df.where(where).orderBy(*order(time, key))
    return rows if limit is None else rows.limit(limit)


def read_page(df: DataFrame, time: str, key: str, start: datetime, end: datetime, cursor: Cursor, limit: int) -> Page:
    """One page and the cursor after it. An empty page moves the time to the range's end."""
    rows = range_scan(df, time, key, start, end, cursor, limit)
    n, last = rows.agg(F.count("*"), F.max(F.struct(F.col(time).alias("at"), F.col(key).cast("long").alias("id")))).first()
    after_page = Cursor(last["at"], last["id"]) if n else Cursor(end, cursor.id)
    if n and after_page == cursor:
        raise RuntimeError("the cursor did not advance")
    return Page(rows, n, after_page, n < limit)


def number_pages(df: DataFrame, within: list[str], time: str, key: str, size: int, step: str = "month") -> DataFrame:
    """Adds page, from 0, to each row: its place among the rows of its range (``within``).

    A range is dealt out by ``step`` of the time, and each step's rows are
    numbered on from the count of those before: no task sorts a whole range,
    and the counts are a row for each range and step.
    """
    stepped = df.withColumn("_step", F.date_trunc(step, F.col(time)))
    counts = stepped.groupBy(*within, "_step").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*within).orderBy(F.col("_step").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select(*[F.col(w).alias(f"_f{w}") for w in within], F.col("_step").alias("_f"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    met = stepped.join(F.broadcast(first), [F.col(w).eqNullSafe(F.col(f"_f{w}")) for w in within] + [F.col("_step").eqNullSafe(F.col("_f"))])
    at = F.col("_before") + F.row_number().over(Window.partitionBy(*within, "_step").orderBy(*order(time, key)))
    return met.withColumn("page", F.floor((at - 1) / size).cast("long")).drop("_step", "_f", "_before", *[f"_f{w}" for w in within])


def pages(df: DataFrame, within: list[Column], time: str, key: str, size: int, step: str = "month") -> DataFrame:
    """Each page's rows, last cursor, and whether reading stops after it (it is not full)."""
    names = [f"_w{i}" for i in range(len(within))]
    narrow = df.select(time, key, *[c.alias(n) for n, c in zip(names, within, strict=True)])
    numbered = number_pages(narrow, names, time, key, size, step)
    return numbered.groupBy(*names, "page").agg(F.count("*").alias("n_rows"), F.max(F.struct(F.col(time).alias("at"), F.col(key).alias("id"))).alias("last")).withColumn("exhausted", F.col("n_rows") < size)


def unscanned(df: DataFrame, time: str) -> DataFrame:
    """Rows that no range can reach, because their time is null."""
    return df.where(F.col(time).isNull())
