"""Counting sets from blocked tid lists (J4, A2) without moving a list twice.

Lists ``[sid, psid, item, block, tids]`` are dealt out by block into slots once
and written bucketed by slot.  Candidates of a level, which are output-sized,
are brought to every slot; there the lists on the path of a set are intersected
as bitmaps over the tids of the slot, sets with a common beginning sharing that
part, and only counts leave the slot."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cofreq.session import bucketed_table

TIDS_PER_SLOT = 1_000_000  # entries of lists that one task holds
SETS_AT_ONCE = 500_000  # sets whose extensions a task counts in one go
WORDS_AT_ONCE = 1 << 20  # 64-bit words of bitmaps that are intersected at once


def deal(lists: DataFrame, n_tids: int) -> tuple[DataFrame, int]:
    """The lists bucketed by ``slot``, and the number of slots; ``n_tids`` is
    the number of their entries.  A block lies in one slot."""
    n = max(lists.sparkSession.sparkContext.defaultParallelism, -(-n_tids // TIDS_PER_SLOT))
    slot = F.pmod(F.xxhash64("block"), F.lit(n)).cast("int")
    return bucketed_table(lists.withColumn("slot", slot).repartition(n, "slot"), "slot", n), n


def count_pairs(lists: DataFrame, min_sup: int) -> DataFrame:
    """Item pairs ``[a, b]`` that are frequent together under some parent,
    counted inside the slots where they occur together (pairs that never do are
    not formed)."""
    kind = lists.schema["item"].dataType.simpleString()
    found = lists.select("slot", "psid", "item", "tids").groupBy("slot").applyInArrow(
        _pairs, f"psid bigint, a {kind}, b {kind}, n bigint")
    return found.groupBy("psid", "a", "b").agg(F.sum("n").alias("n")).where(F.col("n") >= min_sup).select("a", "b").distinct()


def count_sets(lists: DataFrame, n_slots: int, wanted: DataFrame, n_wanted: int) -> DataFrame:
    """``[psid, id, support]`` of the sets that ``wanted`` asks for: rows
    ``[psid, path, ids]`` of a set, the lists it is the intersection of, and the
    lists that it is extended by one at a time."""
    slots = lists.sparkSession.range(n_slots).select(F.col("id").cast("int").alias("slot"))
    rounds = -(-n_wanted // SETS_AT_ONCE) or 1
    parts = []
    for i in range(rounds):
        now = wanted if rounds == 1 else wanted.where(F.pmod(F.xxhash64("psid"), F.lit(rounds)) == i)
        asked = now.crossJoin(F.broadcast(slots))  # one row a slot
        parts.append(lists.select("slot", "sid", "tids").groupBy("slot").cogroup(asked.groupBy("slot")).applyInArrow(
            _sets, "psid bigint, id bigint, n bigint"))
    found = reduce(DataFrame.unionAll, parts)
    return found.groupBy("psid", "id").agg(F.sum("n").cast("bigint").alias("support"))


def _flat(lists: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Values and lengths of a column of lists."""
    lists = lists.combine_chunks()
    return lists.flatten().to_numpy(zero_copy_only=False), lists.value_lengths().to_numpy(zero_copy_only=False)


def _pairs(rows: pa.Table) -> pa.Table:
    tids, sizes = _flat(rows["tids"])
    groups, group = np.unique(rows["psid"].to_numpy(), return_inverse=True)
    items, item = np.unique(rows["item"].to_numpy(), return_inverse=True)
    group, item = np.repeat(group, sizes), np.repeat(item, sizes)
    order = np.lexsort((item, tids, group))
    tids, group, item = tids[order], group[order], item[order]
    m, step = len(items), 1
    codes, counts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    while step < len(tids):
        same = (tids[step:] == tids[:-step]) & (group[step:] == group[:-step])
        if not same.any():
            break
        at = np.flatnonzero(same)
        code, n = np.unique((group[at].astype(np.int64) * m + item[at]) * m + item[at + step], return_counts=True)
        codes.append(code)
        counts.append(n)
        step += 1
    code, at = np.unique(np.concatenate(codes), return_inverse=True)
    n = np.bincount(at, np.concatenate(counts), len(code)).astype(np.int64)
    return pa.table({"psid": groups[code // (m * m)], "a": items[code // m % m], "b": items[code % m], "n": n})


class _Bitmaps:
    """The lists of a slot over its tids: dense ones as bitmaps, others as the
    places of their bits, whichever is smaller."""

    def __init__(self, ids: np.ndarray, tids: np.ndarray, sizes: np.ndarray):
        universe, places = np.unique(tids, return_inverse=True)
        self.words = -(-len(universe) // 64)
        self.ids, self.at = np.unique(ids, return_inverse=True)
        of = np.repeat(self.at, sizes)
        places = places[np.argsort(of, kind="stable")]
        held = np.bincount(of, minlength=len(self.ids))
        ends = np.concatenate([[0], np.cumsum(held)])
        dense = np.flatnonzero(held >= self.words)
        self.row = np.full(len(self.ids), -1)
        self.row[dense] = np.arange(len(dense))
        self.maps = np.zeros((len(dense), self.words), np.uint64)
        self.places = {}
        for i in range(len(self.ids)):
            mine = places[ends[i]:ends[i + 1]]
            if self.row[i] >= 0:
                self.maps[self.row[i]] = self._bits(mine)
            else:
                self.places[i] = mine.copy()

    def _bits(self, places: np.ndarray) -> np.ndarray:
        flags = np.zeros(self.words * 64, bool)
        flags[places] = True
        return np.packbits(flags, bitorder="little").view(np.uint64)

    def find(self, ids: np.ndarray) -> np.ndarray:
        """Numbers of lists, -1 where the slot has none."""
        at = np.minimum(np.searchsorted(self.ids, ids), len(self.ids) - 1)
        return np.where(self.ids[at] == ids, at, -1)

    def bitmap(self, i: int) -> np.ndarray:
        if i < 0:
            return np.zeros(self.words, np.uint64)
        return self.maps[self.row[i]] if self.row[i] >= 0 else self._bits(self.places[i])

    def sizes(self, bits: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Sizes of the intersections of ``bits`` with each list."""
        out = np.zeros(len(at), np.int64)
        rows = np.where(at >= 0, self.row[at], -1)
        dense = np.flatnonzero(rows >= 0)
        step = max(1, WORDS_AT_ONCE // max(1, self.words))
        for i in range(0, len(dense), step):
            part = dense[i:i + step]
            out[part] = np.bitwise_count(self.maps[rows[part]] & bits).sum(axis=1)
        rest = np.flatnonzero((at >= 0) & (rows < 0))
        if len(rest):
            flags = np.unpackbits(bits.view(np.uint8), bitorder="little")
            for j in rest.tolist():
                out[j] = np.count_nonzero(flags[self.places[int(at[j])]])
        return out


def _sets(lists: pa.Table, wanted: pa.Table) -> pa.Table:
    none = np.zeros(0, np.int64)
    if not lists.num_rows or not wanted.num_rows:
        return pa.table({"psid": none, "id": none, "n": none})
    tids, sizes = _flat(lists["tids"])
    maps = _Bitmaps(lists["sid"].to_numpy(), tids, sizes)
    paths, lengths = _flat(wanted["path"])
    paths = maps.find(paths).reshape(-1, int(lengths[0]))  # the sets of a level are of one length
    ids, n_ids = _flat(wanted["ids"])
    ends = np.concatenate([[0], np.cumsum(n_ids)])
    at, names = maps.find(ids), wanted["psid"].to_numpy()
    path, bits, out = [], [], []
    for r in np.lexsort(paths.T[::-1]).tolist():
        mine = paths[r].tolist()
        common = 0
        while common < len(path) and path[common] == mine[common]:
            common += 1
        del bits[common:]
        for x in mine[common:]:
            bits.append(bits[-1] & maps.bitmap(x) if bits else maps.bitmap(x))
        path = mine
        if not bits[-1].any():
            continue
        n = maps.sizes(bits[-1], at[ends[r]:ends[r + 1]])
        some = np.flatnonzero(n)
        out.append((np.full(len(some), names[r]), ids[ends[r]:ends[r + 1]][some], n[some]))
    columns = [np.concatenate(c) for c in zip(*out)] if out else [none] * 3
    return pa.table(dict(zip(("psid", "id", "n"), columns)))
