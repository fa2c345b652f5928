"""Substring deduplication over a log-structured index of window hashes.

A window is ``k`` consecutive words of one document. A window is a repeat if
its words also start in a document of an earlier batch, or of a smaller id in
its own batch; every word that a repeat covers is removed. Windows are judged
on the texts as they came in.

The index holds each different window hash once, with the first document and
word position that had it, as immutable runs: files bucketed by hash range
whose rows are sorted, compressed columns. A batch goes through these steps.

1. Each task hashes the windows of its texts, sorts them, settles repeats among
   its own documents, and sends one entry for each different hash to the hash's
   bucket: a passage found in every document costs one entry a task. Where
   there are more buckets than a task deals to, entries are dealt twice, and
   what meets on the way is settled there: a hash that every task has comes to
   its bucket as one entry for each ``REGROUP_BYTES`` that passed.
2. Each bucket merges the batch's entries with the runs' and sends the repeats
   to their document's shard. The runs are read bucket by bucket where they
   lie; only the batch is shuffled.
3. Each shard joins neighbouring repeats to spans, each with its source's place.
4. Verification: texts meet their spans, and a digest of the span's words must
   equal that of the source's words; in the same pass repeats are removed. A
   source is asked once for each different span, however many copied it. If any
   span differs (two texts with one hash), the steps are run again with those
   windows hashed by another function of their words.
5. The batch's new hashes become a run. When the newest run has two thirds of
   the size of the one before, the two are compacted into one, so a probe reads
   few of them and each entry is rewritten O(log) times.

An index with a path lives on: a later call, in another application too, opens
it, judges its documents against all that came before, and leaves it with their
windows. Its entries have 32 bits more of a second hash, because texts of
earlier calls are not there to be compared; repeats are compared within the call
and equal in 96 bits with earlier ones. When its buckets outgrow their bound,
all runs are dealt into more. One writer at a time.

Defined cases: a null text has no words; rows with a null id are returned whole
and count for no other row; rows that share an id never count against each
other within a call, whether their texts are equal or not; a document that is
given to an index again is a repeat of itself; texts under ``k`` words have no
window; an empty table gives an empty result; other columns pass through, but
for those named as the result's.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterable, Iterator
from hashlib import blake2b, sha256
from itertools import compress
from uuid import uuid4

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Hasher, discard, durable, exists, packed, put_text, read_text, scratch, sliced, small, split_words, unpacked

ENTRY, HIT, ALIAS, RUN = 0, 1, 2, 3
#: Columns of packed rows: a place is a document, its tag and a word's position.
PLACE = [("doc", "<i8"), ("tag", "<u4"), ("pos", "<u4")]
KINDS = {
    ENTRY: [("hash", "<u8"), *PLACE],
    RUN: [("hash", "<u8"), *PLACE],
    HIT: [*PLACE, ("sdoc", "<i8"), ("stag", "<u4"), ("spos", "<u4")],
    ALIAS: [*PLACE, ("first", "<u4")],
}
SPAN = [*KINDS[HIT], ("len", "<u4")]
ROWS = "kind int, key int, blob binary"
SLOTTED = f"{ROWS}, slot int"
SPANS = f"{ROWS}, sdoc long, stag long, spos long, len long"
SPANS_ARROW = pa.schema([("kind", pa.int32()), ("key", pa.int32()), ("blob", pa.binary()), *[(c, pa.int64()) for c in ("sdoc", "stag", "spos", "len")]])

Columns = dict[str, np.ndarray]
#: (kind, key, blob)
Packed = tuple[int, int, bytes]

#: Bytes of text that are hashed and sorted at once.
CHUNK = 2 << 20
#: Bytes of text for each hash bucket, and the fewest buckets; from FAN buckets on, they grow to the larger size first.
BUCKET_BYTES, MOST_BUCKET_BYTES, BUCKETS = 2 << 20, 16 << 20, 64
#: Most buckets or shards that one task deals to. More are dealt in two steps, so that a packed row stays long.
FAN = 4096
#: Packed rows' bytes, unpacked, that the second dealing sorts at once.
REGROUP_BYTES = 32 << 20


def buckets_for(total: int) -> int:
    """The hash buckets for so many bytes of text, a power of two."""
    n = BUCKETS
    while (n < FAN and n * BUCKET_BYTES < total) or n * MOST_BUCKET_BYTES < total:
        n *= 2
    return n


def pack(table: Columns, kind: list[tuple[str, str]]) -> bytes:
    """Columns as byte planes, the first as differences if it rises: sorted hashes and near-constant ids become short."""
    out = []
    for name, dtype in kind:
        column = np.ascontiguousarray(table[name], dtype)
        if name == "hash":
            column = np.diff(column, prepend=column.dtype.type(0))
        out.append(column.view(np.uint8).reshape(len(column), column.dtype.itemsize).T.tobytes())
    return zstandard.ZstdCompressor(level=1).compress(b"".join(out))


def unpack(blobs: list[bytes], kind: list[tuple[str, str]]) -> Columns:
    unzip, width = zstandard.ZstdDecompressor(), sum(np.dtype(t).itemsize for _, t in kind)
    parts: dict[str, list[np.ndarray]] = {name: [] for name, _ in kind}
    for blob in blobs:
        data = np.frombuffer(unzip.decompress(blob), np.uint8)
        n, at = len(data) // width, 0
        for name, dtype in kind:
            size = np.dtype(dtype).itemsize
            column = np.ascontiguousarray(data[at : at + n * size].reshape(size, n).T).view(dtype).ravel()
            parts[name].append(np.cumsum(column, dtype=np.uint64) if name == "hash" else column)
            at += n * size
    return {name: np.concatenate(parts[name]) if parts[name] else np.zeros(0, dtype) for name, dtype in kind}


def take(table: Columns, at: np.ndarray) -> Columns:
    return {name: column[at] for name, column in table.items()}


def distinct(columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Where each different row stands first, in order, and the number of each row's among them."""
    columns = [c for c in columns if len(c) and c.min() != c.max()] or columns[:1]
    order = np.lexsort(columns[::-1]) if len(columns) > 1 else np.argsort(columns[0], kind="stable")
    new = np.ones(len(order), bool)
    new[1:] = np.logical_or.reduce([c[order[1:]] != c[order[:-1]] for c in columns]) if len(order) else True
    number = np.empty(len(order), np.int64)
    number[order] = np.cumsum(new) - 1
    return order[new], number


def _dealt(table: Columns, kind: int, key: np.ndarray, columns: list[tuple[str, str]]) -> Iterator[Packed]:
    """A packed row for each key that occurs."""
    order = np.argsort(key, kind="stable")
    key, table = key[order], take(table, order)
    edges = np.concatenate(([0], np.flatnonzero(key[1:] != key[:-1]) + 1, [len(key)])) if len(key) else [0]
    for begin, end in zip(edges[:-1], edges[1:], strict=True):
        yield kind, int(key[begin]), pack({n: c[begin:end] for n, c in table.items()}, columns)


def prime_from(n: int) -> int:
    while any(n % d == 0 for d in range(2, int(n**0.5) + 1)):
        n += 1
    return n


class Plan:
    """What the steps share; small, and sent with each task's code."""

    def __init__(self, k: int, buckets: int, tagged: bool, seed: int, suspects: np.ndarray, checked: bool = False):
        self.k, self.buckets, self.tagged, self.seed, self.suspects, self.checked = k, buckets, tagged, seed, suspects, checked
        #: Of each kind's packed rows the columns; entries of an index that lives on have more of a hash.
        self.kinds = KINDS | {kind: [*KINDS[kind], ("check", "<u4")] for kind in (ENTRY, RUN)} if checked else KINDS
        self.shift = np.uint64(64 - buckets.bit_length() + 1)
        self.shards = prime_from(buckets)
        self.wide = buckets > FAN

    def tag(self, text: bytes) -> int:
        return zlib.crc32(text) if self.tagged else 0

    def shard(self, doc: np.ndarray) -> np.ndarray:
        return np.mod(doc, self.shards)

    def key(self, table: Columns, kind: int, coarse: bool) -> np.ndarray:
        """The bucket or, behind the buckets, the shard of each row; when there are many and it is coarse, of a range of them."""
        if kind in (ENTRY, RUN):
            fine = (table["hash"] >> self.shift).astype(np.int64)
            return fine // (self.buckets // FAN) if coarse and self.wide else fine
        fine = self.shard(table["doc"])
        return self.buckets + (fine % FAN if coarse and self.wide else fine)

    def deal(self, table: Columns, kind: int, coarse: bool = True) -> Iterator[Packed]:
        return _dealt(table, kind, self.key(table, kind, coarse), self.kinds[kind])

    def same(self, table: Columns) -> np.ndarray:
        """Of each row of a sorted table whether it has the hash of the one before."""
        out = np.zeros(len(table["hash"]), bool)
        out[1:] = table["hash"][1:] == table["hash"][:-1]
        if self.checked:
            out[1:] &= table["check"][1:] == table["check"][:-1]
        return out

    def by_hash(self, table: Columns, *then: str) -> np.ndarray:
        """The order by hash, and by ``then``; ties as they came."""
        columns = [*reversed(then), *(["check"] if self.checked else []), "hash"]
        return np.argsort(table["hash"], kind="stable") if len(columns) == 1 else np.lexsort([table[c] for c in columns])

    def settle(self, table: Columns) -> tuple[Columns, Columns]:
        """The repeats among some entries, and the entries that are left for the bucket: of each hash those of the smallest document."""
        table = take(table, self.by_hash(table, "doc", "tag", "pos"))
        lead = ~self.same(table)
        first = take(table, np.flatnonzero(lead)[np.cumsum(lead) - 1]) if len(lead) else table
        later = table["doc"] > first["doc"]
        return take(table, np.flatnonzero(later)) | {"s" + n: first[n][later] for n, _ in PLACE}, take(table, np.flatnonzero(~later))

    def deal_again(self, rows: Iterator[Packed], settle: bool = False) -> Iterator[Packed]:
        """From ranges of buckets or shards to single ones; rows come sorted by (key, kind)."""
        at, blobs, size = None, [], 0

        def flush() -> Iterator[Packed]:
            table = unpack(blobs, self.kinds[at[1]])
            if settle and at[1] == ENTRY:
                hits, table = self.settle(table)
                yield from self.deal(hits, HIT)
            if "hash" in table:
                table = take(table, np.argsort(table["hash"], kind="stable"))
            yield from self.deal(table, at[1], coarse=False)

        for kind, key, blob in rows:
            if blobs and (at != (key, kind) or size >= REGROUP_BYTES):
                yield from flush()
                blobs, size = [], 0
            at = (key, kind)
            blobs.append(blob)
            size += zstandard.frame_content_size(blob)
        if blobs:
            yield from flush()

    def windows(self, docs: list[int], texts: list[bytes]) -> Columns:
        """Every window of some texts, in the order of (doc, tag, pos)."""
        hasher = Hasher(self.seed)
        rows = sorted(range(len(docs)), key=lambda i: (docs[i], self.tag(texts[i])))
        texts = [texts[i] for i in rows]
        data, starts, ends, n = split_words(texts)
        hashes = hasher.windows(hasher.words(data, starts, ends), self.k)
        row = np.repeat(np.arange(len(texts)), n)
        pos = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        whole = np.flatnonzero(row[: len(hashes)] == row[len(row) - len(hashes) :])
        tags = np.array([self.tag(t) for t in texts], np.uint32)
        row = row[whole]
        hashes = hashes[whole]
        for i in np.flatnonzero(np.isin(hashes, self.suspects)) if len(self.suspects) else ():
            at = range(whole[i], whole[i] + self.k)  # this hash belongs to windows of different words
            hashes[i] = int.from_bytes(blake2b(b" ".join(bytes(data[starts[w] : ends[w]]) for w in at), digest_size=8).digest(), "little")
        out = {"hash": hashes, "doc": np.array([docs[i] for i in rows], np.int64)[row], "tag": tags[row], "pos": pos[whole].astype(np.uint32)}
        if self.checked:
            other = Hasher(self.seed + 1)
            out["check"] = (other.windows(other.words(data, starts, ends), self.k)[whole] >> np.uint64(32)).astype(np.uint32)
        return out

    def first_step(self, docs: list[int], texts: list[bytes]) -> Iterator[Packed]:
        """Entries for the buckets; repeats and windows that a document has twice, for the shards."""
        table = self.windows(docs, texts)
        table = take(table, self.by_hash(table))
        lead = ~self.same(table)
        first = take(table, np.flatnonzero(lead)[np.cumsum(lead) - 1]) if len(lead) else table
        later = (table["doc"] > first["doc"]) & ~lead
        # of the leader's own document: settled with it. Another text of one id is judged apart.
        twin = (table["doc"] == first["doc"]) & (table["tag"] == first["tag"]) & ~lead
        apart = (table["doc"] == first["doc"]) & (table["tag"] != first["tag"])
        sent = np.flatnonzero(lead | apart)
        yield from self.deal(take(table, sent), ENTRY)
        hits = take(table, np.flatnonzero(later)) | {"s" + n: first[n][later] for n, _ in PLACE}
        yield from self.deal(hits, HIT)
        twins = take(table, np.flatnonzero(twin)) | {"first": first["pos"][twin]}
        yield from self.deal(twins, ALIAS)

    def merge(self, fresh: Columns, held: Columns) -> tuple[Columns, Columns]:
        """The repeats among ``fresh``, and the first place of every hash that is new."""
        old = len(held["hash"])
        table = {n: np.concatenate((held[n], fresh[n])) for n, _ in self.kinds[RUN]}
        new = np.arange(len(table["hash"])) >= old
        order = np.argsort(table["hash"], kind="stable")
        h = table["hash"][order]
        same = np.zeros(len(h) + 1, bool)
        same[1:-1] = h[1:] == h[:-1]
        shared = same[1:] | same[:-1]
        several = order[shared]  # only equal hashes are ordered any further
        columns = [table["pos"], table["tag"], table["doc"], new, *([table["check"]] if self.checked else []), table["hash"]]
        order[shared] = several[np.lexsort([c[several] for c in columns])]
        table, new = take(table, order), new[order]
        lead = ~self.same(table)
        first = np.flatnonzero(lead)[np.cumsum(lead) - 1] if len(lead) else np.zeros(0, np.int64)
        repeat = new & ~lead & (~new[first] | (table["doc"][first] < table["doc"]))
        hits = take(table, np.flatnonzero(repeat)) | {"s" + n: table[n][first[repeat]] for n, _ in PLACE}
        return hits, take(table, np.flatnonzero(lead & new))

    def second_step(self, key: int, fresh: pa.Table, held: pa.Table | None, keep: bool) -> pa.Table:
        """Packed rows with their slot, the group's own key: what a task writes stays in its own bucket files."""
        if key >= self.buckets:
            return fresh.select(["kind", "key", "blob"]).append_column("slot", pa.array([key] * len(fresh), pa.int32()))
        hits, run = self.merge(unpack(blobs_of(fresh), self.kinds[ENTRY]), unpack([] if held is None else blobs_of(held), self.kinds[RUN]))
        out = list(self.deal(hits, HIT))
        if keep and len(run["hash"]):
            out.append((RUN, key, pack(run, self.kinds[RUN])))
        return _slotted(out, key)

    def third_step(self, rows: pa.Table) -> pa.Table:
        """Spans for the documents' shard (kind 0, packed), and the shard's different requests to sources (kind 1, a row each)."""
        kinds = rows.column("kind").to_numpy()
        hits = unpack(blobs_of(rows.filter(pa.array(kinds == HIT))), KINDS[HIT])
        twins = unpack(blobs_of(rows.filter(pa.array(kinds == ALIAS))), KINDS[ALIAS])
        if not len(hits["doc"]):
            return pa.Table.from_arrays([pa.array([], f.type) for f in SPANS_ARROW], schema=SPANS_ARROW)
        row = distinct([np.concatenate((hits[n], twins[n])) for n in ("doc", "tag")])[1] << 32
        place = row[: len(hits["doc"])] | hits["pos"].astype(np.int64)
        order = np.argsort(place, kind="stable")
        place, hits = place[order], take(hits, order)
        if len(twins["doc"]):
            wanted = row[len(place) :] | twins["first"].astype(np.int64)
            at = np.minimum(np.searchsorted(place, wanted), len(place) - 1)
            found = np.flatnonzero(place[at] == wanted)
            more = take(hits, at[found]) | {"pos": twins["pos"][found]}
            place = np.concatenate((place, (row[len(place) :][found]) | more["pos"].astype(np.int64)))
            hits = {n: np.concatenate((hits[n], more[n])) for n in hits}
            order = np.argsort(place, kind="stable")
            place, hits = place[order], take(hits, order)
        begin = np.ones(len(place), bool)
        step = np.diff(hits["spos"].astype(np.int64))
        begin[1:] = (np.diff(place) != 1) | (np.diff(hits["sdoc"]) != 0) | (np.diff(hits["stag"].astype(np.int64)) != 0) | (step != 1)
        at = np.flatnonzero(begin)
        spans = take(hits, at) | {"len": np.diff(np.append(at, len(place))).astype(np.uint32)}
        source = {n: spans["s" + n] for n, _ in PLACE} | {"len": spans["len"]}
        source = take(source, distinct([source[n] for n in source])[0])
        n = len(source["doc"])
        own = [[0], [int(self.shard(spans["doc"][:1])[0])], [pack(spans, SPAN)], *[[None]] * 4]
        asked = [np.ones(n, np.int32), self.shard(source["doc"]).astype(np.int32), [None] * n, *[source[c].astype(np.int64) for c in ("doc", "tag", "pos", "len")]]
        return pa.Table.from_arrays([pa.concat_arrays([pa.array(a, f.type), pa.array(b, f.type)]) for a, b, f in zip(own, asked, SPANS_ARROW, strict=True)], schema=SPANS_ARROW)


def _arrays(rows: Iterable[Packed]) -> list[pa.Array]:
    kind, key, blob = zip(*rows) if (rows := list(rows)) else ((), (), ())  # noqa: B905
    return [pa.array(kind, pa.int32()), pa.array(key, pa.int32()), pa.array(blob, pa.binary())]


def _batch(rows: Iterable[Packed]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(_arrays(rows), names=["kind", "key", "blob"])


def _table(rows: Iterable[Packed]) -> pa.Table:
    return pa.Table.from_arrays(_arrays(rows), names=["kind", "key", "blob"])


def _slotted(rows: Iterable[Packed], slot: int) -> pa.Table:
    table = _table(rows)
    return table.append_column("slot", pa.array([slot] * len(table), pa.int32()))


def blobs_of(rows: pa.Table) -> list[bytes]:
    return rows.column("blob").to_pylist()


def one_by_one(plan: Plan, rows: DataFrame, settle: bool = False) -> DataFrame:
    """Packed rows by single bucket or shard; a second dealing, where entries can be settled, where there are more than one task deals to."""
    if not plan.wide:
        return rows

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = (row for b in sliced(batches) for row in zip(*(b.column(c).to_pylist() for c in ("kind", "key", "blob")), strict=True))
        held: list[Packed] = []
        for row in plan.deal_again(each, settle):
            held.append(row)
            if len(held) >= 1024:
                yield _batch(held)
                held = []
        if held:
            yield _batch(held)

    return rows.repartition("key").sortWithinPartitions("key", "kind").select("kind", "key", "blob").mapInArrow(again, ROWS)


def _index_by_row(table: Columns) -> dict[tuple[int, int], Columns]:
    if not len(table["doc"]):
        return {}
    order = np.lexsort((table["pos"], table["tag"], table["doc"]))
    table = take(table, order)
    edge = np.flatnonzero((np.diff(table["doc"]) != 0) | (np.diff(table["tag"].astype(np.int64)) != 0)) + 1
    bounds = [0, *edge.tolist(), len(order)]
    return {(int(table["doc"][b]), int(table["tag"][b])): {n: c[b:e] for n, c in table.items()} for b, e in zip(bounds[:-1], bounds[1:], strict=True)}


def covered(n: int, spans: Columns | None, k: int) -> np.ndarray:
    edges = np.zeros(n + 1, np.int64)
    if spans is not None:
        np.add.at(edges, spans["pos"].astype(np.int64), 1)
        np.add.at(edges, spans["pos"].astype(np.int64) + spans["len"] + k - 1, -1)
    return np.cumsum(edges)[:-1] > 0


CHECKED = [("_sdoc", pa.int64()), ("_stag", pa.int64()), ("_spos", pa.int64()), ("_len", pa.int64()), ("_digest", pa.binary()), ("_asked", pa.bool_())]
OUT = ["n_words", "n_removed", "kept_sha256", "kept_text"]


def _clean(plan: Plan, with_text: bool):
    """The fourth step: rows sorted by shard, spans before texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, blobs, asked, spans = None, [], {}, None
        for batch in sliced(batches):
            seen: set[tuple] = set()
            keep, made, texts = [], [], []
            column = {n: batch.column(n) for n in batch.schema.names}
            kinds, shards = column["_kind"].to_numpy(), column["_shard"].to_numpy()
            for i in range(batch.num_rows):
                if shards[i] != shard:
                    shard, blobs, asked, spans = int(shards[i]), [], {}, None
                if kinds[i] == 0:
                    blobs.append(column["_blob"][i].as_py())
                    continue
                if kinds[i] == 1:
                    sdoc, stag, spos, n = (column[c][i].as_py() for c in ("_sdoc", "_stag", "_spos", "_len"))
                    asked.setdefault((sdoc, stag), []).append((spos, n))
                    continue
                if spans is None:
                    spans = _index_by_row(unpack(blobs, SPAN))
                body = (column["_text"][i].as_py() or "").encode()
                words, doc = body.split(), column["_doc"][i].as_py()
                row = None if doc is None else (doc, plan.tag(body))
                mine = spans.get(row)
                digest = lambda pos, n, words=words: blake2b(b" ".join(words[pos : pos + n + plan.k - 1]), digest_size=16).digest()
                for pos, n in asked.get(row, ()):
                    seen.add((*row, pos, n, digest(pos, n), False))
                for j in range(0 if mine is None else len(mine["pos"])):
                    n = int(mine["len"][j])
                    seen.add((*(int(mine[c][j]) for c in ("sdoc", "stag", "spos")), n, digest(int(mine["pos"][j]), n), True))
                gone = covered(len(words), mine, plan.k) if mine is not None else None
                left = words if gone is None else list(compress(words, (~gone).tolist()))
                # a text with nothing removed stays as it was, white space included
                joined = b" ".join(left)
                keep.append(i)
                made.append((len(words), len(words) - len(left), sha256(joined).hexdigest()))
                if with_text:
                    texts.append(column["_text"][i].as_py() if gone is None else joined.decode())
            n, checked = len(keep), sorted(seen)
            if not n and not checked:
                continue
            own = [column["_rest"].take(pa.array(keep, pa.int64()))]
            own += [pa.array([m[j] for m in made], t) for j, t in enumerate((pa.int64(), pa.int64(), pa.string()))]
            own += [pa.array(texts, pa.string())] if with_text else []
            own = [pa.concat_arrays([a, pa.nulls(len(checked), a.type)]) for a in own]
            rest = [pa.concat_arrays([pa.nulls(n, t), pa.array([c[j] for c in checked], t)]) for j, (_, t) in enumerate(CHECKED)]
            yield pa.RecordBatch.from_arrays([*own, *rest], names=["_rest", *OUT[: 3 + with_text], *[c for c, _ in CHECKED]])

    return run


class WindowIndex:
    """The log-structured index below a path: runs, newest last, and a manifest that names them and what they were made with."""

    def __init__(self, spark: SparkSession, path: str, plan: Plan, runs: Iterable[tuple[str, int]] = (), files: int = 0, version: int = 0):
        self.spark, self.path, self.plan, self.version = spark, path.rstrip("/"), plan, version
        self.files = files or min(plan.buckets, max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1))
        self.runs: list[tuple[str, int]] = [tuple(r) for r in runs]  # folder, entries' bytes
        self.spent: list[str] = []
        self._names: list[str] = []

    @classmethod
    def manifest(cls, spark: SparkSession, path: str) -> dict | None:
        text = read_text(spark, f"{path.rstrip('/')}/manifest.json")
        return json.loads(text) if text else None

    def keep(self) -> None:
        """Let the present runs take effect for later calls; until then a call that breaks off has changed nothing."""
        plan = self.plan
        put_text(self.spark, f"{self.path}/manifest.json", json.dumps({"k": plan.k, "seed": plan.seed, "buckets": plan.buckets, "files": self.files, "runs": self.runs, "version": self.version + 1}))
        for folder in self.spent:
            discard(self.spark, f"{self.path}/{folder}")
        for folder, _ in self.runs:  # the batches are judged
            for kind in (HIT, ALIAS):
                discard(self.spark, f"{self.path}/{folder}/kind={kind}")

    def _table(self, folders: Iterable[str]) -> DataFrame:
        """Some runs' entries as one table with buckets, a partition for each run. The files' names have the buckets, so that it can be opened anywhere."""
        name = f"window_run_{uuid4().hex}"
        self._names.append(name)
        self.spark.sql(f"CREATE TABLE {name} (key INT, blob BINARY, run STRING) USING parquet PARTITIONED BY (run) CLUSTERED BY (key) INTO {self.files} BUCKETS LOCATION '{self.path}/{name}'")
        for folder in folders:
            self.spark.sql(f"ALTER TABLE {name} ADD PARTITION (run = '{folder}') LOCATION '{self.path}/{folder}/kind={RUN}'")
        return self.spark.table(name).select("key", "blob")

    def _save(self, rows: DataFrame) -> tuple[str, int]:
        """Write packed rows by kind and their slot's bucket; the folder, and its entries' bytes."""
        folder, name = f"run-{uuid4().hex}", f"window_run_{uuid4().hex}"
        rows.write.partitionBy("kind").bucketBy(self.files, "slot").option("path", f"{self.path}/{folder}").option("compression", "none").format("parquet").saveAsTable(name)
        self.spark.sql(f"DROP TABLE {name}")  # the files stay
        held = exists(self.spark, f"{self.path}/{folder}/kind={RUN}")
        return folder, self.spark.read.schema("key int, blob binary").parquet(f"{self.path}/{folder}/kind={RUN}").agg(F.sum(F.octet_length("blob"))).first()[0] if held else 0

    def held(self) -> DataFrame | None:
        folders = [folder for folder, size in self.runs if size]
        return self._table(folders) if folders else None

    def add(self, docs: DataFrame, keep: bool = True) -> DataFrame:
        """Judge a batch (columns _doc, _text) against the runs and itself, and take it in; returns packed repeats."""
        plan = self.plan

        def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            docs, texts, size = [], [], 0
            for batch in sliced(batches):
                for doc, text in zip(batch.column("_doc").to_pylist(), batch.column("_text").to_pylist(), strict=True):
                    docs.append(doc)
                    texts.append((text or "").encode())
                    size += len(texts[-1])
                    if size >= CHUNK:
                        yield _batch(plan.first_step(docs, texts))
                        docs, texts, size = [], [], 0
            if docs:
                yield _batch(plan.first_step(docs, texts))

        fresh = one_by_one(plan, docs.where(F.col("_doc").isNotNull()).select("_doc", "_text").mapInArrow(first, ROWS), settle=True)
        held = self.held()
        if held is None:
            merged = fresh.groupBy("key").applyInArrow(lambda key, rows: plan.second_step(key[0].as_py(), rows, None, keep), SLOTTED)
        else:
            # a bucket without fresh entries has nothing to say
            merged = fresh.groupBy("key").cogroup(held.groupBy("key")).applyInArrow(lambda key, rows, old: plan.second_step(key[0].as_py(), rows, old, keep) if len(rows) else _slotted((), 0), SLOTTED)
        folder, size = self._save(merged)
        if keep:
            self.runs.append((folder, size))
        else:
            self.spent.append(folder)
        hits = [f"{self.path}/{folder}/kind={kind}" for kind in (HIT, ALIAS) if exists(self.spark, f"{self.path}/{folder}/kind={kind}")]
        if not hits:
            return self.spark.createDataFrame([], ROWS)
        return self.spark.read.schema("key int, blob binary, kind int").option("basePath", f"{self.path}/{folder}").parquet(*hits).select("kind", "key", "blob")

    def _merge(self, folders: list[str]) -> tuple[str, int]:
        """One run of two. Bucket meets bucket; nothing is shuffled."""
        plan = self.plan

        def join(key: tuple, a: pa.Table, b: pa.Table) -> pa.Table:
            parts = unpack([*blobs_of(a), *blobs_of(b)], plan.kinds[RUN])  # the hashes of two runs differ
            return _slotted([(RUN, key[0].as_py(), pack(take(parts, plan.by_hash(parts)), plan.kinds[RUN]))], key[0].as_py())

        old, new = (self._table([f]).groupBy("key") for f in folders)
        return self._save(old.cogroup(new).applyInArrow(join, SLOTTED))

    def compact(self, always: bool = False) -> None:
        """Merge the newest runs while the newer has at least two thirds of the size of the older."""
        self.runs = [r for r in self.runs if r[1]] or self.runs[:1]
        while len(self.runs) > 1 and (always or 3 * self.runs[-1][1] >= 2 * self.runs[-2][1]):
            folders = [f for f, _ in self.runs[-2:]]
            self.runs[-2:] = [self._merge(folders)]
            self.spent += folders

    def grow(self, most: int) -> None:
        """Deal all runs into more buckets when they hold over ``most`` bytes each."""
        total, buckets = sum(n for _, n in self.runs), self.plan.buckets
        while buckets * most < total:
            buckets *= 2
        if buckets == self.plan.buckets:
            return
        plan = self.plan = Plan(self.plan.k, buckets, self.plan.tagged, self.plan.seed, self.plan.suspects, self.plan.checked)
        held = self.held()

        def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for blob in batch.column("blob").to_pylist():
                    yield _batch(plan.deal(unpack([blob], plan.kinds[RUN]), RUN, coarse=False))

        def join(key: tuple, rows: pa.Table) -> pa.Table:
            parts = unpack(blobs_of(rows), plan.kinds[RUN])
            return _slotted([(RUN, key[0].as_py(), pack(take(parts, plan.by_hash(parts)), plan.kinds[RUN]))], key[0].as_py())

        made = self._save(held.select("blob").mapInArrow(deal, ROWS).groupBy("key").applyInArrow(join, SLOTTED))
        self.spent += [f for f, _ in self.runs]
        self.runs = [made]

    def close(self) -> None:
        """Forget the tables; the files stay."""
        for name in self._names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
            discard(self.spark, f"{self.path}/{name}")
        self._names = []


def _spans(rows: DataFrame, index: WindowIndex, bounds: list[int], path: str, keep_all: bool) -> None:
    """Steps one to three: take in the batches, and write the spans of repeats."""
    plan, edges, found = index.plan, [None, *bounds, None], None
    for i, (low, high) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
        part = rows if low is None else rows.where(F.col("_doc") > low)
        part = part if high is None else part.where(F.col("_doc") <= high)
        keep = keep_all or i < len(bounds)  # nothing follows the last that would probe its run
        hits = index.add(part, keep)
        if keep:
            index.compact()
        found = hits if found is None else found.unionAll(hits)
    one_by_one(plan, found).groupBy("key").applyInArrow(lambda rows: plan.third_step(rows), SPANS).write.parquet(path)


def _fourth_step(rows: DataFrame, plan: Plan, spans: str, with_text: bool) -> DataFrame:
    """Texts with their spans: judged, cleaned and written in one pass."""
    spark, rest = rows.sparkSession, rows.schema["_rest"].dataType
    null = lambda name: F.lit(None).cast(rows.schema[name].dataType).alias(name)
    asked = ["sdoc", "stag", "spos", "len"]
    # a much-copied source is asked by every shard: each different request goes on once
    given = spark.read.schema(SPANS).parquet(spans)
    given = given.where("kind = 0").select("blob", "kind", "key", *asked).unionAll(given.where("kind = 1").select(F.lit(None).cast("binary"), "kind", "key", *asked).distinct())
    given = given.select(*[null(c) for c in rows.columns], F.col("blob").alias("_blob"), *[F.col(c).alias(f"_{c}") for c in asked], F.col("kind").alias("_kind"), F.col("key").alias("_shard"))
    shard = F.coalesce(F.pmod(F.col("_doc"), F.lit(plan.shards)), F.lit(0)).cast("int")
    placed = rows.select("*", F.lit(None).cast("binary").alias("_blob"), *[F.lit(None).cast("long").alias(f"_{c}") for c in asked], F.lit(2).alias("_kind"), shard.alias("_shard")).unionAll(given)
    kinds = ["long", "long", "string", "string"][: 3 + with_text]
    schema = T.StructType([T.StructField("_rest", rest)])
    for name, kind in [*zip(OUT, kinds), *[(c, {"bool": "boolean", "binary": "binary"}.get(str(t), "long")) for c, t in CHECKED]]:  # noqa: B905
        schema = schema.add(name, kind)
    path = scratch(spark, "deduplicated")
    clean = _clean(plan, with_text)
    placed.repartition("_shard").sortWithinPartitions("_shard", "_kind").mapInArrow(clean, schema).write.option("compression", "zstd").parquet(path)
    return spark.read.schema(schema).parquet(path)


def _shared_hashes(rows: DataFrame, plan: Plan, bad: DataFrame) -> np.ndarray:
    """The hashes of the windows that begin at the failed spans' sources: about one in 10**10 windows."""
    places = bad.groupBy(F.col("_sdoc").alias("_doc")).agg(F.collect_list(F.struct("_stag", "_spos", "_len")).alias("at"))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            docs, texts, at = (batch.column(c).to_pylist() for c in ("_doc", "_text", "at"))
            table = plan.windows(docs, [(t or "").encode() for t in texts])
            wanted = {(d, p["_stag"], p["_spos"] + j) for d, ps in zip(docs, at, strict=True) for p in ps for j in range(p["_len"])}
            mine = [h for h, *place in zip(*(table[n].tolist() for n in ("hash", "doc", "tag", "pos")), strict=True) if tuple(place) in wanted]
            yield pa.RecordBatch.from_arrays([pa.array(np.array(mine, np.uint64).view(np.int64))], names=["h"])

    found = rows.select("_doc", "_text").join(small(places), "_doc").select("_doc", "_text", "at").mapInArrow(find, "h long").distinct().toArrow()
    return found["h"].to_numpy().astype(np.int64).view(np.uint64)


def deduplicate(docs: DataFrame, k: int = 13, batches: int = 4, text: str = "text", key: str = "doc_id", with_text: bool = False, seed: int = 1, index: str | None = None) -> DataFrame:
    """The rows of ``docs`` without the column ``text``, with n_words, n_removed, kept_sha256 and, if asked for, kept_text.

    The documents are taken in by ``batches`` batches of rising ids. kept_text
    is the text itself where nothing is removed, else the kept words joined by
    a space; kept_sha256 is always of the kept words. index: a folder of the
    shared file system, whose index (none at first) they are judged against and
    taken into; without it the index ends with the call.
    """
    rows = docs.select(packed(docs, [text, *OUT]).alias("_rest"), F.col(text).cast("string").alias("_text"), F.col(key).cast("long").alias("_doc"))
    body = F.coalesce(F.col("_text"), F.lit(""))
    each = rows.select("_doc", F.octet_length(body).alias("n"), F.crc32(F.encode(body, "UTF-8")).alias("crc"))
    each = each.groupBy("_doc").agg(F.sum("n").alias("n"), F.min("crc").alias("lo"), F.max("crc").alias("hi"))
    cuts = F.array(*[F.lit(i / max(batches, 2)) for i in range(1, max(batches, 2))])
    clash = (F.col("lo") != F.col("hi")) & F.col("_doc").isNotNull()
    total, clashes, bounds = each.agg(F.sum("n"), F.max(clash), F.percentile_approx("_doc", cuts, 10000)).first()
    spark, buckets = docs.sparkSession, buckets_for(total or 0)
    bounds, suspects = sorted(set(bounds or [])) if batches > 1 else [], np.zeros(0, np.uint64)
    known = WindowIndex.manifest(spark, index) if index else None
    if known and known["k"] != k:
        raise ValueError(f"the index is of windows of {known['k']} words")
    while True:
        spans, path = scratch(spark, "spans"), index or scratch(spark, "index")
        if known:
            made = WindowIndex(spark, path, Plan(k, known["buckets"], True, known["seed"], suspects, True), known["runs"], known["files"], known["version"])
        else:
            made = WindowIndex(spark, path, Plan(k, buckets, bool(clashes) or index is not None, seed, suspects, index is not None))
        plan = made.plan
        try:
            if known:
                made.grow(MOST_BUCKET_BYTES)
                plan = made.plan
            _spans(rows, made, bounds, spans, index is not None)
            result = _fourth_step(rows, plan, spans, with_text)
            # each span's words must be its source's words
            told = result.where("_digest IS NOT NULL").groupBy("_sdoc", "_stag", "_spos", "_len")
            told = told.agg(F.min("_digest").alias("lo"), F.max("_digest").alias("hi"), F.bool_and("_asked").alias("alone"))
            # a source of an earlier call has no text here
            bad = durable(told.where("lo <> hi" if index else "lo <> hi OR alone").select("_sdoc", "_stag", "_spos", "_len"))
            if bad.isEmpty():
                if index:
                    made.keep()
                return result.where("_digest IS NULL").select(*unpacked("_rest", docs, [text, *OUT]), *OUT[: 3 + with_text])
            if index:
                raise RuntimeError("two texts agree in 96 bits of a window's hash: build the index with another seed")
            discard(spark, result.inputFiles()[0].rsplit("/", 1)[0])
            more = np.union1d(suspects, _shared_hashes(rows, plan, bad))
            if len(more) == len(suspects):
                raise RuntimeError("words differ, but no window's hash is shared: the texts changed between two readings")
            suspects = more
        finally:
            made.close()
            discard(spark, spans)
            if not index:
                discard(spark, path)
