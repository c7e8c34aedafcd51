"""Basket-level operators: parsing into transactions, item counting,
pruning, transposition to tid lists and the item rank."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cofreq.functions.itemsets import tid_block
from cofreq.session import materialize, maybe_broadcast

DEFAULT_BLOCK = 1 << 16


def baskets(df: DataFrame, tid: str = "tid", item: str = "item") -> DataFrame:
    """Long table -> ``[tid, items]`` with items sorted and distinct.
    A transaction's array is bounded by its own item count."""
    return df.groupBy(F.col(tid).alias("tid")).agg(
        F.array_sort(F.collect_set(item)).alias("items")
    )


def explode_items(tx: DataFrame) -> DataFrame:
    """One row per (tid, item); duplicates inside a line count once."""
    return tx.select("tid", F.explode(F.array_distinct("items")).alias("item"))


def transaction_count(tx: DataFrame) -> DataFrame:
    """Number of transactions as a one-row DataFrame."""
    return tx.agg(F.count(F.lit(1)).alias("n_transactions"))


def item_supports(basket: DataFrame) -> DataFrame:
    """A1: support of every item (partial + final hash aggregate)."""
    return basket.groupBy("item").agg(F.count(F.lit(1)).alias("support"))


def frequent_items(basket: DataFrame, min_sup: int) -> DataFrame:
    """A1 + P1: items with ``support >= min_sup`` (min_sup is an absolute count)."""
    return item_supports(basket).where(F.col("support") >= F.lit(min_sup))


def prune_items(basket: DataFrame, keep: DataFrame) -> DataFrame:
    """P2, long form: drop (tid, item) rows whose item is not in ``keep``.
    ``keep`` is broadcast only when its size is proven small."""
    return basket.join(maybe_broadcast(keep.select("item")), "item", "left_semi")


def restrict_items(tx: DataFrame, allowed: list[int]) -> DataFrame:
    """P2, array form for a fixed, small item list (the reference's
    restricted line parsing)."""
    lit = F.array(*[F.lit(int(i)) for i in allowed]).cast("array<bigint>")
    return tx.withColumn("items", F.array_sort(F.array_intersect("items", lit)))


def filter_min_length(tx: DataFrame, k: int) -> DataFrame:
    """Transactions that can hold a k-itemset."""
    return tx.where(F.size("items") >= F.lit(k))


def transpose(basket: DataFrame, block_size: int = DEFAULT_BLOCK) -> DataFrame:
    """A3 + O3: horizontal -> vertical, ``[item, block, support, tids]``.

    Tids are kept per tid-range block so that every row stays bounded
    (at most ``block_size`` tids) however frequent the item is; an item's
    support is the sum over its blocks."""
    return (
        basket.select("item", "tid", tid_block("tid", block_size).alias("block"))
        .groupBy("item", "block")
        .agg(F.array_sort(F.collect_set("tid")).alias("tids"))
        .withColumn("support", F.size("tids").cast("bigint"))
        .select("item", "block", "support", "tids")
    )


def vertical_supports(vertical: DataFrame, keys: tuple[str, ...] = ("item",)) -> DataFrame:
    """Support per key from blocked tid lists."""
    return vertical.groupBy(*keys).agg(F.sum(F.size("tids")).cast("bigint").alias("support"))


def merge_tids(partials: DataFrame, keys: tuple[str, ...] = ("item",), block_size: int = DEFAULT_BLOCK) -> DataFrame:
    """A4: concatenate partial tid lists (one per split/part) of the same key.

    Rows are regrouped by (key, tid block) so a merged row stays bounded."""
    exploded = partials.select(*keys, F.explode("tids").alias("tid"))
    return (
        exploded.withColumn("block", tid_block("tid", block_size))
        .groupBy(*keys, "block")
        .agg(F.array_sort(F.collect_set("tid")).alias("tids"))
    )


def global_rank(df: DataFrame, order_cols: list[str], name: str = "rank") -> DataFrame:
    """Dense 1-based row number over the whole table in ``order_cols`` order
    without a single-partition window: range-partition + local sort, then add
    per-partition offsets (one small row per partition)."""
    n_parts = max(1, df.sparkSession.sparkContext.defaultParallelism)
    ordered = (
        df.repartitionByRange(n_parts, *order_cols)
        .sortWithinPartitions(*order_cols)
        .withColumn("_pid", F.spark_partition_id())
        .withColumn("_mono", F.monotonically_increasing_id())
    )
    ordered = materialize(ordered)
    counts = ordered.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    offsets = counts.select(
        "_pid",
        (F.sum("_n").over(Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1))).alias("_off"),
    ).fillna(0, subset=["_off"])
    # offsets has one row per partition: a fixed, small broadcast side.
    return (
        ordered.join(F.broadcast(offsets), "_pid")
        .withColumn(
            name,
            (F.col("_off") + F.col("_mono") - F.shiftleft(F.col("_pid").cast("bigint"), 33) + 1).cast("int"),
        )
        .drop("_pid", "_mono", "_off")
    )


def item_rank(freq_items: DataFrame) -> DataFrame:
    """Position (1-based) of each frequent item in ascending support,
    ties by item ascending."""
    return global_rank(freq_items.select("item", "support"), ["support", "item"])
