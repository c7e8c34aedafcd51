"""Mergeable Misra-Gries summaries of 64-bit hashes, one for each hash partition:
which hashes may occur ``threshold`` times or more in a table.

The leading bits of a hash name its partition.  A task sorts the hashes of
``HELD`` occurrences at a time and hands back, for each partition, the distinct
keys with their counts, packed; one pass over the summaries of a partition
merges them.  No frequent hash is lost; the number of hashes beside them is
bounded by mass and threshold."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cofreq.llm.common import batch_sizes, give_back
from cofreq.session import ship_package

KEY_BITS = 36  # of a hash within its partition
HEADROOM = 2  # capacity is this many times mass / threshold
HELD = 1_000_000  # occurrences that a task sorts at a time
COUNTERS = 1 << 18  # of a partition, about
MAX_BITMAP_BITS = 30  # 128 MB

M1, M2, M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * M2
    x = (x ^ (x >> np.uint64(27))) * M3
    return x ^ (x >> np.uint64(31))


def pack(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """Sorted distinct keys of at most 40 bits, with counts, as bytes: planes of
    the differences, which compress well, and 32-bit counts."""
    import zstandard

    gaps = np.diff(keys, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8)[:, :5].T
    planes = counts.astype("<u4").view(np.uint8).reshape(-1, 4).T
    return zstandard.compress(gaps.tobytes() + planes.tobytes(), 1)


def unpack(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    import zstandard

    raw = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(9, -1)
    gaps = np.zeros((raw.shape[1], 8), np.uint8)
    gaps[:, :5] = raw[:5].T
    return np.cumsum(gaps.view("<u8").ravel(), dtype=np.uint64), np.ascontiguousarray(raw[5:].T).view("<u4").ravel().astype(np.int64)


def added(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and the sums of their counts."""
    order = np.argsort(keys)
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts[order], first) if len(first) else counts[:0]


class Summary:
    """A mergeable Misra-Gries summary: ``keys`` with ``counts``, of each of
    which at most ``off`` occurrences have been taken off."""

    def __init__(self, capacity: int, threshold: int):
        self.capacity, self.threshold, self.off = max(1, capacity), threshold, 0
        self.keys, self.counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.waiting: list = []
        self.n_waiting = 0

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.waiting.append((keys, counts))
        self.n_waiting += len(keys)
        if self.n_waiting > max(self.capacity, COUNTERS):
            self.settle()

    def settle(self) -> None:
        if not self.waiting:
            return
        keys, counts = zip((self.keys, self.counts), *self.waiting)
        self.keys, self.counts = added(np.concatenate(keys), np.concatenate(counts))
        self.waiting, self.n_waiting = [], 0
        while len(self.keys) > self.capacity:
            cut = len(self.counts) - self.capacity - 1
            value = int(np.partition(self.counts, cut)[cut])
            if self.off + value > self.threshold // HEADROOM:
                self.capacity *= 2  # exact in any case: more counters rather than a larger error
                continue
            self.off += value
            keep = self.counts > value
            self.keys, self.counts = self.keys[keep], self.counts[keep] - value

    def survivors(self) -> np.ndarray:
        """The keys that may have ``threshold`` occurrences."""
        self.settle()
        return self.keys[self.counts + self.off >= self.threshold]


def partition_bits(spark_cores: int, threshold: int, mass: int) -> int:
    """Bits that name a hash partition: about ``COUNTERS`` counters in each, and
    some partitions for every core."""
    return max(4, (2 * spark_cores - 1).bit_length(), (HEADROOM * mass // (threshold * COUNTERS)).bit_length())


def frequent_hashes(df: DataFrame, hashes: Callable[[pa.RecordBatch], Iterable[np.ndarray]], threshold: int, mass: int) -> DataFrame:
    """``[part, key]``, the leading bits of every hash that ``hashes`` gives at
    least ``threshold`` times for the batches of ``df``, and of some others.
    ``mass`` (an estimate of the number of occurrences) sets the number of
    partitions and their first capacity only."""
    part_bits = partition_bits(df.sparkSession.sparkContext.defaultParallelism, threshold, mass)
    n_parts = 1 << part_bits
    capacity = HEADROOM * mass // (threshold * n_parts) + 1
    shift, low = np.uint64(64 - part_bits - KEY_BITS), np.uint64((1 << KEY_BITS) - 1)

    def handed(held: list) -> pa.RecordBatch:
        h = np.sort(np.concatenate(held) >> shift)
        first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        keys, counts = h[first], np.diff(first, append=len(h))
        ends = np.searchsorted(keys, np.arange(n_parts + 1, dtype=np.uint64) << np.uint64(KEY_BITS))
        found = [(p, pack(keys[a:b] & low, counts[a:b])) for p, (a, b) in enumerate(zip(ends[:-1], ends[1:])) if b > a]
        return pa.RecordBatch.from_arrays([pa.array([p for p, _ in found], pa.int32()), pa.array([s for _, s in found], pa.binary())],
                                          names=["part", "summary"])

    def summarise(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for h in hashes(batch):
                if len(h):
                    held.append(h)
                    size += len(h)
                if size >= HELD:
                    yield handed(held)
                    held, size = [], 0
        if held:
            yield handed(held)
        give_back()

    def merge(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, summary = None, None

        def done() -> pa.RecordBatch:
            keys = summary.survivors()
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), part), pa.int32()), pa.array(keys.view(np.int64))],
                                              names=["part", "key"])

        for batch in batches:
            for p, packed in zip(batch.column("part").to_pylist(), batch.column("summary").to_pylist()):
                if p != part:
                    if part is not None:
                        yield done()
                    part, summary = p, Summary(capacity, threshold)
                summary.add(*unpack(packed))
        if part is not None:
            yield done()
        give_back()

    ship_package(df.sparkSession)
    batch_sizes(df.sparkSession)
    packed = df.mapInArrow(summarise, "part int, summary binary")
    return packed.repartition(n_parts, "part").sortWithinPartitions("part").mapInArrow(merge, "part int, key bigint")


def hash_bitmap(found: DataFrame, threshold: int, mass: int) -> tuple[np.ndarray, int]:
    """The hashes ``frequent_hashes(..., threshold, mass)`` as a bitmap over
    their first ``bits`` bits, and ``bits``.  At most 128 MB reach the driver."""
    part_bits = partition_bits(found.sparkSession.sparkContext.defaultParallelism, threshold, mass)
    bits = min(MAX_BITMAP_BITS, max(18, (8 * mass // threshold).bit_length()))
    place = F.shiftrightunsigned(F.shiftleft(F.col("part").cast("bigint"), KEY_BITS).bitwiseOR(F.col("key")),
                                 part_bits + KEY_BITS - bits) + 1
    rows = found.select(place.alias("place")).groupBy(F.bitmap_bucket_number("place").alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("place")).alias("bitmap")).collect()
    out = np.zeros((1 << bits) // 8, np.uint8)
    for r in rows:
        piece = np.frombuffer(bytes(r["bitmap"]), np.uint8)
        at = (r["bucket"] - 1) * len(piece)
        out[at:at + len(piece)] = piece[:len(out) - at]
    return out, bits


def in_bitmap(h: np.ndarray, bitmap: np.ndarray, bits: int) -> np.ndarray:
    """Which hashes the bitmap lets through."""
    place = (h >> np.uint64(64 - bits)).astype(np.int64)
    return (bitmap[place >> 3] >> (place & 7).astype(np.uint8) & 1).astype(bool)
