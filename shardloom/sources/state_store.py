"""A small versioned key-value store for a move's state, kept as one file a version. The driver is its only writer.

Keys with prefixes, point reads with revisions, and conditional writes: put if
absent, compare and set, compare and delete, delete by prefix. A version is
written beside the last and takes effect by a rename that never replaces: it
fails if another writer was first, on HDFS as on a local file system.
"""

from __future__ import annotations

import json
from dataclasses import dataclass
from uuid import uuid4

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Entry:
    value: str
    revision: int


class StateStore:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._at = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._at(self.path).getFileSystem(spark._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._at(self.path))

    def _versions(self) -> list[int]:
        return sorted(int(f.getPath().getName()[1:-5]) for f in self._fs.listStatus(self._at(self.path)) if f.getPath().getName().endswith(".json"))

    def _load(self) -> tuple[int, dict[str, Entry]]:
        versions = self._versions()
        if not versions:
            return 0, {}
        stream = self._fs.open(self._at(f"{self.path}/v{versions[-1]:012d}.json"))
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return versions[-1], {k: Entry(*v) for k, v in json.loads(text).items()}

    def _save(self, version: int, entries: dict[str, Entry]) -> bool:
        target = self._at(f"{self.path}/v{version + 1:012d}.json")
        draft = self._at(f"{self.path}/.draft-{version + 1}-{uuid4().hex}")
        stream = self._fs.create(draft, True)
        try:
            stream.write(json.dumps({k: [e.value, e.revision] for k, e in entries.items()}).encode())
        finally:
            stream.close()
        jvm = self.spark._jvm
        options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), self.spark._jsc.hadoopConfiguration()).rename(draft, target, options)
        except Py4JJavaError as lost:
            self._fs.delete(draft, False)
            if "FileAlreadyExists" in str(lost.java_exception):
                return False
            raise
        for old in self._versions()[:-2]:
            self._fs.delete(self._at(f"{self.path}/v{old:012d}.json"), False)
        return True

    def _change(self, change) -> bool:
        version, entries = self._load()
        after = change(dict(entries), version + 1)
        return after is not None and self._save(version, after)

    def get(self, key: str) -> Entry | None:
        return self._load()[1].get(key)

    def exists(self, key: str) -> bool:
        return self.get(key) is not None

    def prefix(self, prefix: str) -> list[tuple[str, Entry]]:
        return sorted((k, e) for k, e in self._load()[1].items() if k.startswith(prefix))

    def put(self, key: str, value: str) -> bool:
        return self._change(lambda held, r: held | {key: Entry(value, r)})

    def put_all(self, values: dict[str, str]) -> bool:
        return self._change(lambda held, r: held | {k: Entry(v, r) for k, v in values.items()})

    def put_if_absent(self, key: str, value: str) -> bool:
        return self._change(lambda held, r: None if key in held else held | {key: Entry(value, r)})

    def compare_and_set(self, key: str, value: str, revision: int) -> bool:
        return self._change(lambda held, r: held | {key: Entry(value, r)} if key in held and held[key].revision == revision else None)

    def compare_and_delete(self, key: str, revision: int) -> bool:
        return self._change(lambda held, _: {k: e for k, e in held.items() if k != key} if key in held and held[key].revision == revision else None)

    def delete(self, key: str) -> bool:
        return self._change(lambda held, _: {k: e for k, e in held.items() if k != key} if key in held else None)

    def delete_prefix(self, prefix: str) -> bool:
        return self._change(lambda held, _: {k: e for k, e in held.items() if not k.startswith(prefix)})

    def table(self) -> DataFrame:
        """The store as (key, value, revision)."""
        rows = [(k, e.value, e.revision) for k, e in sorted(self._load()[1].items())]
        return self.spark.createDataFrame(rows, "key string, value string, revision long")


def prefix_scan(table: DataFrame, prefix: str) -> DataFrame:
    return table.where(F.col("key").startswith(prefix)).orderBy("key")


def decode(value: Column, schema: str) -> Column:
    """A state document; fields that the schema doesn't have are ignored."""
    return F.from_json(value, schema)


def encode(document: Column) -> Column:
    return F.to_json(document)
