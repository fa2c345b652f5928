"""Shared pieces: durable intermediate tables and vectorised word hashing.

Words are maximal runs of bytes other than space and \\t..\\r (ASCII white
space); multi-byte UTF-8 characters never contain those bytes, so working on
bytes is exact.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"

#: Texts of about this many bytes are hashed together; bounds a Python worker's arrays.
CHUNK_BYTES = 1 << 20

_WS = np.zeros(256, bool)
_WS[[9, 10, 11, 12, 13, 32]] = True
_POWERS = 1 << 16
#: A struct's last field, for tables without other columns.
_NOTHING = "__nothing"


def shared_dir(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; where it is unset, a temporary one in local mode, as in tests, and an error on a cluster."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
            spark.sparkContext.setCheckpointDir(path)
        return path
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if held.isEmpty():
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the whole cluster shares")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="shardloom-"))
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
    return held.get()


def durable(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder for a written intermediate table."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows as a compressed table of the shared folder, for what is too wide for a checkpoint."""
    path = scratch(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard_table(df: DataFrame) -> None:
    """Delete the files of a table that was ``written``, once nothing reads it any more."""
    for folder in {path.rsplit("/", 1)[0] for path in df.inputFiles()}:
        discard(df.sparkSession, folder)


#: Rows of a counted narrow table for each task that reads it.
TASK_ROWS = 50_000


def tasks_for(rows: int, each: int = TASK_ROWS) -> int:
    return max(1, -(-rows // each))


def counted(df: DataFrame) -> tuple[DataFrame, int]:
    """A narrow table, cut off, and its rows; read by as many tasks as those need, however many partitions it was made in."""
    df = durable(df)
    rows = df.count()
    return df.coalesce(tasks_for(rows)), rows


def small(df: DataFrame, most: int = 1_000_000) -> DataFrame:
    """A narrow table, cut off and counted: sent to every executor by the joins that use it if it has at most ``most`` rows, else shuffled by them."""
    df = durable(df)
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def discard(spark: SparkSession, path: str) -> None:
    """Delete a scratch table through Hadoop's file system, wherever the shared folder lives."""
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def _file(spark: SparkSession, path: str) -> tuple:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    at, files = _file(spark, path)
    return files.exists(at)


def read_text(spark: SparkSession, path: str) -> str | None:
    """A small file's text, or nothing."""
    at, files = _file(spark, path)
    if not files.exists(at):
        return None
    stream = files.open(at)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def put_text(spark: SparkSession, path: str, text: str) -> None:
    """Write a small file whole: it appears under its name by a rename."""
    (at, files), draft = _file(spark, path), _file(spark, f"{path}.{uuid.uuid4().hex}")[0]
    stream = files.create(draft, True)
    try:
        stream.write(text.encode())
    finally:
        stream.close()
    jvm = spark._jvm
    replace = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    replace[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(at.toUri(), spark._jsc.hadoopConfiguration()).rename(draft, at, replace)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def named(name: str) -> Column:
    """A column by its whole name, dots included."""
    return F.col("`" + name.replace("`", "``") + "`")


def packed(df: DataFrame, left_out: Iterable[str]) -> Column:
    """All columns but some as one struct, so that no name of theirs meets one of an operator's own."""
    left_out = set(left_out)
    return F.struct(*[named(c) for c in df.columns if c not in left_out], F.lit(None).cast("boolean").alias(_NOTHING))


def unpacked(column: str, df: DataFrame, left_out: Iterable[str]) -> list[Column]:
    left_out = set(left_out)
    return [F.col(column).getField(c).alias(c) for c in df.columns if c not in left_out]


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift-multiply), in place on a copy."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class Hasher:
    """64-bit hashes of words and of windows of words, a seed apart from each other."""

    def __init__(self, seed: int = 1):
        rng = np.random.Generator(np.random.PCG64(seed))
        self.table = rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.table[_WS] = 0
        self.powers = mix64(rng.integers(1, 2**63, _POWERS, dtype=np.uint64)) | np.uint64(1)

    def words(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, most: int | None = None) -> np.ndarray:
        """A hash for each word, or for its first ``most`` bytes."""
        if not len(starts):
            return np.zeros(0, np.uint64)
        kind = np.int32 if len(data) < 2**31 else np.int64
        at = np.arange(len(data), dtype=kind)
        at -= np.repeat(starts.astype(kind), np.diff(np.concatenate(([0], starts[1:], [len(data)]))))
        at &= _POWERS - 1
        value = self.table[data]
        value *= self.powers[at]
        if most is not None:
            value[at >= most] = 0
        return mix64(np.add.reduceat(value, starts) + (ends - starts if most is None else np.minimum(ends - starts, most)).astype(np.uint64))

    def windows(self, words: np.ndarray, k: int) -> np.ndarray:
        """One hash for each run of k words; empty when there are fewer."""
        n = len(words) - k + 1
        if n <= 0:
            return np.zeros(0, np.uint64)
        out = np.zeros(n, np.uint64)
        for j in range(k):
            out += words[j : j + n] * self.powers[j + 1]
        return mix64(out)


def split_words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of texts joined by a space: the bytes, each word's start and end, and the number of words in each text."""
    data = np.frombuffer(b" ".join([*texts, b""]), np.uint8)
    inside = np.concatenate(([False], ~_WS[data], [False]))
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    begins = np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts], dtype=np.int64)))
    return data, starts, ends, np.diff(np.searchsorted(starts, begins))


def chunks(sizes: list[int], most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose sizes add up to about ``most``; a larger row stands alone."""
    begin = total = 0
    for i, n in enumerate(sizes):
        if total and total + n > most:
            yield begin, i
            begin, total = i, 0
        total += n
    if begin < len(sizes):
        yield begin, len(sizes)


#: Rows of an Arrow batch that are turned into Python objects at once.
SLICE_ROWS = 512


def sliced(batches: Iterator) -> Iterator:
    """The batches in short slices, without a copy: a worker's objects don't grow with Spark's batch size."""
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE_ROWS):
            yield batch.slice(at, SLICE_ROWS)


def append_columns(df: DataFrame, inputs: list[str], fields: list[tuple[str, str]], compute, keep: list[str] | None = None) -> DataFrame:
    """``keep`` (else all but ``inputs``) as they are, and the columns that ``compute(*lists of inputs)`` returns as Arrow arrays.

    Columns that only pass through stay in Arrow, so nulls and wide integers are safe.
    """
    import pyarrow as pa
    from pyspark.sql import types as T

    kept = keep if keep is not None else [c for c in df.columns if c not in inputs]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            made = compute(*[batch.column(c).to_pylist() for c in inputs])
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], *made], names=[*kept, *[f[0] for f in fields]])

    schema = T.StructType([df.schema[c] for c in kept])
    for name, kind in fields:
        schema = schema.add(name, T._parse_datatype_string(kind))
    return df.mapInArrow(run, schema)
