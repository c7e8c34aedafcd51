"""Operator 10: approximate nearest neighbours by multiprobe p-stable hashing.

Largest inner product is turned into smallest Euclidean distance by the usual
extra coordinate (all vectors scaled to the largest norm).  Each of several
tables hashes a vector to the cell of K random Gaussian projections of width
W.  A query visits its own cell and then perturbed cells (one step in some
projections), in the order of their estimated success: a template over the
sorted distances to the cell walls, computed once.  Candidates of all visited
cells are compared with the query by exact inner product in double precision
and merged.

K follows the number of rows (cells hold about ``CELL_ROWS``).  The number of
probes is the smallest that finds 95 % of the true neighbours of a bounded
number of calibration queries, which are compared with every row; if all
one-step cells are not enough, K is lowered (down to one cell: exact search).
A query that finds fewer rows than there are to find (an outlier whose cells
hold too few) is asked again with half the K, down to one cell, so every query
gets ``top`` rows, or all others if there are fewer.
Every row is indexed.  A cell with many rows is split into parts of about
``PART_ROWS`` and each of its queries visits all parts, so no cell has to fit
one task.

Defined results: vectors that are null, zero, of another than the commonest
length, or hold null or non-finite components take no part, as query or
candidate, nor do rows without id; of rows with the same id one counts (the
smallest vector); ties go to the smaller id; other columns are ignored."""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cofreq.llm.common import map_arrow, stage

TABLES = 4
CELL_ROWS = 3_000
PART_ROWS = 8_192
QUERY_ROWS = 8_192
CALIBRATION = 64  # queries
SAMPLE_ROWS = 2_000  # rows that the projections' spread is estimated from
TARGET_RECALL = 0.95


def probe_template(k: int) -> list[tuple[int, ...]]:
    """Perturbation sets over the 2K wall distances in ascending order (index
    j and 2K - 1 - j are the two walls of one projection), by expected squared
    distance; the empty set comes first."""
    m = 2 * k
    j = np.arange(1, m + 1)
    cost = np.where(j <= k, j * (j + 1) / (4 * (k + 1) * (k + 2)),
                    1 - (m + 1 - j) / (k + 1) + (m + 1 - j) * (m + 2 - j) / (4 * (k + 1) * (k + 2)))
    out, heap = [()], [(cost[0], (0,))] if k else []
    while heap and len(out) < 3 ** min(k, 7):
        c, s = heapq.heappop(heap)
        if all(m - 1 - x not in s for x in s):
            out.append(s)
        last = s[-1]
        if last + 1 < m:
            heapq.heappush(heap, (c - cost[last] + cost[last + 1], (*s[:-1], last + 1)))
            heapq.heappush(heap, (c + cost[last + 1], (*s, last + 1)))
    return out


class Hashing:
    """Projections of all tables for vectors of one dimension."""

    def __init__(self, dim: int, k: int, tables: int, top: float, spread: float, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.k, self.tables, self.top, self.width = k, tables, top, 2 * spread
        self.a = rng.standard_normal((tables, dim + 1, k)) / np.sqrt(dim + 1)
        self.b = rng.uniform(0, self.width, (tables, k))
        self.mix = rng.integers(1, 1 << 62, (tables, k), dtype=np.int64) | 1
        self.template = probe_template(k)

    def places(self, x: np.ndarray, t: int, query: bool) -> np.ndarray:
        norm = np.linalg.norm(x, axis=1)
        if query:
            x = np.hstack([x / norm[:, None], np.zeros((len(x), 1))])
        else:
            x = x / self.top
            x = np.hstack([x, np.sqrt(np.maximum(0, 1 - (norm / self.top) ** 2))[:, None]])
        return (x @ self.a[t] + self.b[t]) / self.width

    def code(self, cells: np.ndarray, t: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (cells * self.mix[t]).sum(axis=-1) * 8 + t

    def cells(self, x: np.ndarray, t: int) -> np.ndarray:
        return np.floor(self.places(x, t, False)).astype(np.int64)

    def probes(self, x: np.ndarray, t: int, n: int) -> np.ndarray:
        """[queries, probes, K]: the cells visited, in order."""
        p = self.places(x, t, True)
        home = np.floor(p).astype(np.int64)
        away = np.concatenate([p - home, 1 - (p - home)], axis=1)  # distance to the lower, then the upper wall
        order = np.argsort(away, axis=1, kind="stable")
        # make places j and 2K - 1 - j the two walls of one projection
        low = order[:, :self.k]
        rank = np.concatenate([low, (low[:, ::-1] + self.k) % (2 * self.k)], axis=1) if self.k else order
        out = np.repeat(home[:, None, :], min(n, len(self.template)), axis=1)
        rows = np.arange(len(x))
        for i, s in enumerate(self.template[:n]):
            for j in s:
                w = rank[:, j]
                out[rows, i, w % self.k] += np.where(w < self.k, -1, 1)
        return out


def _top(q_id: np.ndarray, q: np.ndarray, r_id: np.ndarray, r: np.ndarray, top: int):
    """Best rows of each query in one block: (query, row, score) arrays.  The
    matrix product only selects, with room for its rounding; scores are sums of
    products in the order of the components, so equal vectors have equal scores
    wherever they stand."""
    out = [], [], []
    room = 8 * r.shape[1] * np.finfo(float).eps * np.sqrt((r * r).sum(axis=1).max(initial=0))
    for at in range(0, len(q_id), 256):
        s = q[at:at + 256] @ r.T
        s[q_id[at:at + 256][:, None] == r_id[None, :]] = -np.inf
        floor = -np.partition(-s, top - 1, axis=1)[:, top - 1] if s.shape[1] > top else np.full(len(s), -np.inf)
        floor = floor - room * np.sqrt((q[at:at + 256] ** 2).sum(axis=1))
        for i in range(len(s)):
            some = np.flatnonzero((s[i] >= floor[i]) & (s[i] > -np.inf))
            v = (r[some] * q[at + i]).sum(axis=1)
            best = np.lexsort((r_id[some], -v))[:top]
            for o, x in zip(out, (np.full(len(best), q_id[at + i]), r_id[some[best]], v[best])):
                o.append(x)
    return [np.concatenate(o) if o else np.zeros(0) for o in out]


def _best(found: DataFrame, top: int) -> DataFrame:
    once = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return once.withColumn("rank", rank).where(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")


def usable(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """``[vec_id, vec]`` (little-endian doubles) of the rows that take part."""
    v = F.col("vec")
    rows = df.select(F.col(id_col).cast("bigint").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("vec")).where(
        F.col("vec_id").isNotNull() & (F.size(v) > 0)
        & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0))
    length = rows.groupBy(F.size(v).alias("d")).count().orderBy(F.desc("count"), "d").first()
    rows = rows.where(F.size(v) == F.lit(length["d"] if length else 0)).groupBy("vec_id").agg(F.min("vec").alias("vec"))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        col = batch.column("vec")
        d = length["d"]
        flat = np.ascontiguousarray(col.flatten().to_numpy(zero_copy_only=False), "<f8").reshape(-1, d)
        return pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array([x.tobytes() for x in flat], pa.binary())],
                                          names=["vec_id", "vec"])

    return stage(map_arrow(rows, run, "vec_id bigint, vec binary", 4096), "vectors")


def _matrix(blobs) -> np.ndarray:
    blobs = list(blobs)
    return np.frombuffer(b"".join(blobs), "<f8").reshape(len(blobs), -1)


def exact_search(queries: DataFrame, rows: DataFrame, top: int) -> DataFrame:
    """Brute force for a bounded number of queries, which are sent to every task."""
    got = queries.collect()
    q_id, q = np.array([r["vec_id"] for r in got], np.int64), _matrix(bytes(r["vec"]) for r in got)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        a, b, s = _top(q_id, q, batch.column("vec_id").to_numpy(), _matrix(batch.column("vec").to_pylist()), top)
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(s, pa.float64())],
                                          names=["query_id", "vec_id", "score"])

    return _best(map_arrow(rows, run, "query_id bigint, vec_id bigint, score double", 8192), top)


def calibrate(rows: DataFrame, queries: DataFrame, n_rows: int, top: int, tables: int = TABLES) -> tuple[Hashing, int]:
    """Hashing and number of probes for the target recall."""
    sample = rows.orderBy(F.xxhash64("vec_id")).limit(SAMPLE_ROWS).collect()
    x = _matrix(bytes(r["vec"]) for r in sample)
    biggest = float(rows.select(F.max(_norm(rows, x.shape[1])).alias("m")).first()["m"])
    few = stage(queries.orderBy(F.xxhash64("vec_id", F.lit(1))).limit(CALIBRATION), "calibration")
    truth = exact_search(few, rows, top).withColumnRenamed("vec_id", "near")
    near = truth.join(rows.withColumnsRenamed({"vec_id": "near", "vec": "near_vec"}), "near").join(
        few.withColumnRenamed("vec_id", "query_id"), "query_id").select("vec", "near_vec").collect()  # 64 * top rows
    k = max(0, int(np.log(max(1, n_rows / CELL_ROWS)) / np.log(2.6)))
    while True:
        h = Hashing(x.shape[1], k, tables if k else 1, biggest, 1.0)
        if k:
            spread = float(np.std([h.places(x, t, False) - h.b[t] / h.width for t in range(h.tables)]) * h.width)
            h = Hashing(x.shape[1], k, tables, biggest, max(spread, 1e-9))
        if not k or not near:
            return h, 1
        q, r = _matrix(bytes(n["vec"]) for n in near), _matrix(bytes(n["near_vec"]) for n in near)
        reached = np.full(len(near), len(h.template))
        for t in range(h.tables):
            same = (h.probes(q, t, len(h.template)) == h.cells(r, t)[:, None, :]).all(axis=2)
            reached = np.minimum(reached, np.where(same.any(axis=1), same.argmax(axis=1), len(h.template)))
        needed = int(np.sort(reached)[min(len(near) - 1, int(np.ceil(TARGET_RECALL * len(near))))])
        if needed < len(h.template):
            return h, needed + 1
        k -= 1


def _norm(rows: DataFrame, dim: int):
    from pyspark.sql.functions import pandas_udf

    @pandas_udf("double")
    def norm(v: pd.Series) -> pd.Series:
        return pd.Series(np.linalg.norm(_matrix(v), axis=1) if len(v) else [], dtype=float)

    return norm("vec")


def _search(rows: DataFrame, queries: DataFrame, h: Hashing, n_probes: int, top: int) -> DataFrame:
    """``[query_id, vec_id, score]``: the best rows of each visited cell part."""
    shared = rows.sparkSession.sparkContext.broadcast(h)

    def index(batch: pa.RecordBatch) -> pa.RecordBatch:
        x, h = _matrix(batch.column("vec").to_pylist()), shared.value
        code = np.concatenate([h.code(h.cells(x, t), t) for t in range(h.tables)])
        again = pa.array(np.tile(np.arange(len(x)), h.tables))
        return pa.RecordBatch.from_arrays(
            [pa.array(code), batch.column("vec_id").take(again), batch.column("vec").take(again)],
            names=["cell", "vec_id", "vec"])

    def visit(batch: pa.RecordBatch) -> pa.RecordBatch:
        x, h = _matrix(batch.column("vec").to_pylist()), shared.value
        codes = [h.code(h.probes(x, t, n_probes), t) for t in range(h.tables)]
        again = pa.array(np.concatenate([np.repeat(np.arange(len(x)), c.shape[1]) for c in codes]))
        return pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate([c.ravel() for c in codes])), batch.column("vec_id").take(again),
             batch.column("vec").take(again)], names=["cell", "vec_id", "vec"])

    kind = "cell bigint, vec_id bigint, vec binary"
    filed, asked = map_arrow(rows, index, kind, 4096), map_arrow(queries, visit, kind)
    n_parts = lambda d, size, name: d.groupBy("cell").agg(
        F.ceil(F.count(F.lit(1)) / size).cast("int").alias(name))
    cells = stage(n_parts(filed, PART_ROWS, "parts").join(n_parts(asked, QUERY_ROWS, "blocks"), "cell"), "cells")
    part = lambda n: F.pmod(F.xxhash64("vec_id"), F.col(n)).cast("int")
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    side_r = filed.join(cells, "cell").select("cell", part("parts").alias("part"), spread("blocks").alias("block"), "vec_id", "vec")
    side_q = asked.join(cells, "cell").select("cell", spread("parts").alias("part"), part("blocks").alias("block"), "vec_id", "vec")

    def compare(q: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(r):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        a, b, s = _top(q["vec_id"].to_numpy(), _matrix(q["vec"]), r["vec_id"].to_numpy(), _matrix(r["vec"]), top)
        return pd.DataFrame({"query_id": a, "vec_id": b, "score": s})

    key = ["cell", "part", "block"]
    return side_q.groupBy(*key).cogroup(side_r.groupBy(*key)).applyInPandas(
        compare, "query_id bigint, vec_id bigint, score double")


def nearest(df: DataFrame, every: int = 20, top: int = 20, id_col: str = "vec_id", vec_col: str = "embedding",
            tables: int = TABLES) -> DataFrame:
    """``[query_id, rank, vec_id, score]``: for every row whose id is divisible
    by ``every``, the ``top`` nearest of all other rows that were found; fewer
    only if there are fewer other rows."""
    rows = usable(df, id_col, vec_col)
    queries = rows.where(F.col("vec_id") % every == 0)
    n_rows = rows.count()
    if n_rows < 2:
        return _best(rows.where(F.lit(False)).select(F.col("vec_id").alias("query_id"), "vec_id",
                                                     F.lit(0.0).alias("score")), top)
    h, n_probes = calibrate(rows, queries, n_rows, top, tables)
    found = _best(_search(rows, queries, h, n_probes, top), top)
    if not h.k:
        return found
    found = stage(found, "found")
    while h.k:  # queries with too few finds
        enough = found.groupBy("query_id").count().where(F.col("count") >= min(top, n_rows - 1))
        short = stage(queries.join(enough.select(F.col("query_id").alias("vec_id")), "vec_id", "left_anti"), "short")
        if short.isEmpty():
            break
        k = h.k // 2
        h = Hashing(h.a.shape[1] - 1, k, tables if k else 1, h.top, h.width / 2)
        more = _search(rows, short, h, min(len(h.template), max(n_probes, 2 * k + 1)), top)
        found = stage(_best(found.drop("rank").unionByName(more), top), "found")
    return found
