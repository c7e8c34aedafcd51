"""Vertical (tid-list) operators over blocked tid lists
``[item, block, tids]``: intersections (J4) and diffsets (J5).

Work is keyed by (itemset, block), so a frequent item's tids never sit in
one row or one task; supports are sums over blocks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cofreq.operators.condense import extension_ranks  # noqa: F401  (W2)
from cofreq.session import maybe_broadcast


def by_block(vertical: DataFrame) -> DataFrame:
    """The same rows, those of one ``block`` in one partition and about one
    block in each, so that joins on ``block`` and more need no exchange."""
    spark = vertical.sparkSession
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    n = vertical.select("block").distinct().count()
    return vertical.repartition(max(n, spark.sparkContext.defaultParallelism), "block")


def intersect_tids(itemsets: DataFrame, vertical: DataFrame) -> DataFrame:
    """Tid list of each itemset = intersection of its items' lists,
    block by block -> ``[items, block, tids]`` (empty blocks dropped)."""
    flat = itemsets.select("items", F.explode("items").alias("item"))
    per_block = (
        flat.join(vertical.select("item", "block", "tids"), "item")
        .groupBy("items", "block")
        .agg(F.count(F.lit(1)).alias("_n"), F.collect_list("tids").alias("_lists"))
        .where(F.col("_n") == F.size("items"))
    )
    inter = F.aggregate(
        F.slice("_lists", 2, F.greatest(F.size("_lists") - 1, F.lit(0))),
        F.element_at("_lists", 1),
        lambda acc, t: F.array_intersect(acc, t),
    )
    return per_block.select("items", "block", F.array_sort(inter).alias("tids")).where(F.size("tids") > 0)


def diffset_support(pairs: DataFrame, vertical: DataFrame) -> DataFrame:
    """J5 from tid lists: for each candidate ``[a, b]`` the diffset
    ``d = t(a) \\ t(b)`` per block and ``sup(ab) = sup(a) - |d|``.
    Returns ``[a, b, support, diff_size]``."""
    va = vertical.select(F.col("item").alias("a"), "block", F.col("tids").alias("ta"))
    vb = vertical.select(F.col("item").alias("b"), "block", F.col("tids").alias("tb"))
    d = (
        pairs.select("a", "b")
        .join(va, "a")
        .join(vb, ["b", "block"], "left")
        .select("a", "b", F.size(F.array_except("ta", F.coalesce("tb", F.array().cast("array<bigint>")))).alias("_d"),
                F.size("ta").alias("_sa"))
    )
    return d.groupBy("a", "b").agg(
        (F.sum("_sa") - F.sum("_d")).cast("bigint").alias("support"), F.sum("_d").cast("bigint").alias("diff_size")
    )


def diffset_extend(group: DataFrame, pairs: DataFrame) -> DataFrame:
    """J5 one level deeper, from diffsets: inside a prefix group with
    diffsets ``d(x)`` (relative to the prefix) the diffset of ``P∪{x,y}``
    relative to ``P∪{x}`` is ``d(y) \\ d(x)``; ``sup = sup(Px) - |d|``.
    ``group`` is ``[prefix, item, support, block, diff]``; ``pairs`` lists the
    sibling pairs ``[prefix, a, b]`` to extend (e.g. co-occurring ones).

    The diffsets of one prefix and block meet in one place, each of them once
    however many pairs it is in, and only the sizes go on.  A group that is
    partitioned by ``block`` is not moved for that."""
    types = group.schema
    wanted = pairs.groupBy("prefix").agg(F.collect_set(F.struct("a", "b")).alias("pairs"))
    out = (f"prefix {types['prefix'].dataType.simpleString()}, a {types['item'].dataType.simpleString()}, "
           f"b {types['item'].dataType.simpleString()}, sa bigint, d bigint")
    sizes = group.join(maybe_broadcast(wanted), "prefix").groupBy("prefix", "block").applyInArrow(_diff_sizes, out)
    # a pair whose d(y) is empty in every block keeps sup(Px)
    return (
        sizes.groupBy("prefix", "a", "b").agg(F.max("sa").alias("sa"), F.sum("d").alias("d"))
        .where(F.col("sa").isNotNull())
        .select("prefix", "a", "b", (F.col("sa") - F.col("d")).cast("bigint").alias("support"))
    )


def _small(tids: np.ndarray) -> tuple[np.ndarray, int]:
    """Tids as numbers from 0, and a bound on them: their distance from the
    first, or where they lie far apart their place among all."""
    if not len(tids):
        return tids, 0
    first = int(tids.min())
    span = int(tids.max()) - first + 1
    if span <= max(1 << 20, len(tids)):
        return tids - first, span
    names, at = np.unique(tids, return_inverse=True)
    return at, len(names)


def _diff_sizes(rows: pa.Table) -> pa.Table:
    """``[prefix, a, b, sa, d]`` for the pairs of one prefix in one block: the
    support of ``a`` (null where it has no row) and ``|d(b) \\ d(a)|``."""
    pairs = rows["pairs"].combine_chunks().slice(0, 1).flatten()
    a, b = (pairs.field(n).to_numpy(zero_copy_only=False) for n in "ab")
    items = rows["item"].to_numpy()
    diffs = rows["diff"].combine_chunks()
    ends = np.concatenate([[0], np.cumsum(diffs.value_lengths().fill_null(0).to_numpy())])
    values = diffs.flatten().to_numpy(zero_copy_only=False)
    values, n = _small(values)
    at = {item: i for i, item in enumerate(items.tolist())}
    support = rows["support"].to_pylist()
    mark = np.zeros(n, bool)
    order = np.argsort(a, kind="stable")
    sizes, last, mine = np.zeros(len(a), np.int64), None, None
    for k in order.tolist():
        if last is None or a[k] != last:  # the pairs of one item after the other
            if mine is not None:
                mark[mine] = False
            last, i = a[k], at.get(a[k])
            mine = None if i is None else values[ends[i]:ends[i + 1]]
            if mine is not None:
                mark[mine] = True
        j = at.get(b[k])
        if j is not None:
            other = values[ends[j]:ends[j + 1]]
            sizes[k] = len(other) - np.count_nonzero(mark[other])
    prefix = pa.concat_arrays([rows["prefix"].combine_chunks().slice(0, 1)] * len(a)) if len(a) else rows["prefix"].combine_chunks().slice(0, 0)
    sa = [support[at[x]] if x in at else None for x in a.tolist()]
    return pa.table({"prefix": prefix, "a": pairs.field("a"), "b": pairs.field("b"), "sa": pa.array(sa, pa.int64()), "d": sizes})
