"""Shard hashing: CRC-32 of a key's text, modulo routing, and the ring of chained CRC-32 points."""

from __future__ import annotations

import re
import zlib
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..spec import Topology

#: The range of hashes, and the bits of a hash that name its bucket.
SPACE, BUCKET_BITS = 1 << 32, 10


def key_hash(key: Column) -> Column:
    """CRC-32 of the key's text as an unsigned number; null for null."""
    return F.crc32(F.encode(key.cast("string"), "UTF-8"))


def modulo_shard(key: Column, shards: list[str]) -> Column:
    """The shard at the hash modulo the number of shards, in listed order."""
    return F.element_at(F.array(*map(F.lit, shards)), (F.pmod(key_hash(key), F.lit(len(shards))) + 1).cast("int"))


def host_and_port(server: str) -> tuple[str, str]:
    """A server's name and port; no port if what follows the last colon isn't digits."""
    found = re.fullmatch(r"(?s)(.+):([0-9]*)", server)
    return (found[1], found[2]) if found else (server, "")


def chain(server: str, n: int) -> list[int]:
    """A server's ring points: each hashes the server and the point before."""
    host, port = host_and_port(server)
    base = zlib.crc32(host.encode("ascii", "replace") + b"\0" + port.encode("ascii", "replace"))
    points, last = [], 0
    for _ in range(n):
        last = zlib.crc32(last.to_bytes(4, "little"), base)
        points.append(last)
    return points


@lru_cache(maxsize=64)
def ring(topology: Topology) -> tuple[tuple[int, str], ...]:
    """(point, shard) in rising order; of two shards at one point, the later listed."""
    held = {p: s.id for s in topology.shards for p in chain(s.ring_server, s.ring_weight * topology.points)}
    if not held:
        raise ValueError("a topology needs shards")
    return tuple(sorted(held.items()))


@lru_cache(maxsize=64)
def segments(topology: Topology) -> tuple[tuple[int, int, int, str], ...]:
    """(bucket, low, high, shard): the hashes that belong to each point, cut at bucket borders, without gaps."""
    points = ring(topology)
    spans, low = [], 0
    for point, shard in points:
        spans.append((low, point, shard))
        low = point + 1
    if low < SPACE:  # past the last point, the first one's
        spans.append((low, SPACE - 1, points[0][1]))
    width = SPACE >> BUCKET_BITS
    return tuple((b, max(lo, b * width), min(hi, (b + 1) * width - 1), shard) for lo, hi, shard in spans for b in range(lo // width, hi // width + 1))


def locate(key: object, topology: Topology) -> str:
    """One key's shard, on the driver."""
    points, h = ring(topology), zlib.crc32(str(key).encode())
    return next((shard for point, shard in points if point >= h), points[0][1])
