"""F1 level-wise mining and F7 adaptive prefix depth.

Every frequent k-set has a 64-bit id: a level-1 set's id is its item, and a
(k+1)-set's id is ``xxhash64(parent id, item, salt)``.  After each level one
aggregate checks that the new ids are unique; on a collision the level is
re-hashed with another salt, so the result is exact.

The pruned transactions are written once, equal ones with their number.  Every
level reads them, grows the frequent sets found so far inside each transaction
and counts their extensions on the map side: per level only counts are
shuffled, whatever the number of occurrences.  Occurrences with their tids are
derived the same way where they are asked for; none are kept."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cofreq.operators.basket import explode_items, frequent_items
from cofreq.operators.levelwise import (
    DEFAULT_GROUP_LIMIT,
    child_id,
    count_extensions,
    extend_transactions,
    filter_min_support,
    level_to_itemsets,
    merge_transactions,
    occurrences_of,
    prefix_group_stats,
    seed_occurrences,
    split_hot,
)
from cofreq.session import BROADCAST_MAX_ROWS, bucketed_table, materialize


@dataclass
class Levels:
    """Result of the level-wise phase.

    ``levels[k-1]`` holds the frequent k-itemsets as ``[sid, prefix, item,
    support]`` (persisted, output-sized); ``extensions[k]`` is ``[sid, ext]``,
    the items that extend a frequent k-set to a frequent (k+1)-set (written);
    ``occurrences[k]`` (only for the newest level, not computed before it is
    read) is ``[tid, psid, sid, last]``; ``basket`` is the pruned, tid-bucketed
    basket ``[item, tid]`` and ``transactions`` the same as ``[items, n]``."""

    basket: DataFrame
    levels: list[DataFrame] = field(default_factory=list)
    occurrences: dict[int, DataFrame] = field(default_factory=dict)
    extensions: dict[int, DataFrame] = field(default_factory=dict)
    transactions: DataFrame | None = None
    min_sup: int = 1
    sizes: list[int] = field(default_factory=list)
    buckets: int = 8
    salts: list[int] = field(default_factory=list)
    hot: DataFrame | None = None  # tids above the hot-transaction limit
    exhausted: bool = False  # the level after the newest one is known to be empty

    @property
    def depth(self) -> int:
        return len(self.levels)

    def itemsets(self, min_len: int = 1, max_len: int | None = None) -> DataFrame:
        """All frequent itemsets of lengths ``min_len..max_len`` as ``[items, support]``."""
        hi = self.depth if max_len is None else min(max_len, self.depth)
        parts = [level_to_itemsets(self.levels[k - 1]) for k in range(max(1, min_len), hi + 1)]
        if not parts:
            return self.basket.sparkSession.createDataFrame([], "items array<int>, support bigint")
        return reduce(DataFrame.unionByName, parts)

    def release(self) -> None:
        """K7: drop what the level-wise phase keeps (cached level tables).
        Call it once the results built from this object are written."""
        for lv in self.levels:
            lv.unpersist()

    def occurrence_items(self, k: int | None = None) -> DataFrame:
        """Occurrences of level k with their item arrays: ``[tid, items]``
        (a join with the output-sized level table, broadcast when small)."""
        k = self.depth if k is None else k
        lv = self.levels[k - 1].select("sid", F.concat("prefix", F.array("item")).alias("items"))
        lv = _side(lv, self.sizes[k - 1])
        return self.occurrences[k].join(lv, "sid").select("tid", "items")


def as_basket(data: DataFrame) -> DataFrame:
    """Accept ``[tid, items]`` or ``[tid, item]``."""
    return explode_items(data) if "items" in data.columns else data.select("tid", "item")


# (tid, item) rows per bucket of the pruned basket: what one task hashes, sorts
# and nests, whatever the number of transactions
ROWS_PER_BUCKET = 500_000


def _buckets(df: DataFrame, n_rows: int, kept: int = 0) -> int:
    """Bucket count of the tid-bucketed tables: ``spark.cofreq.buckets`` when
    set, else sized from the data (the pruned basket's row count, known from
    the item supports) and never below the cluster's parallelism.  A basket
    kept in as many partitions (``kept``) or up to four times as many sets the
    count: if it was dealt out by tid before (``order_basket``, which counts its
    rows before the pruning), its rows stay where they are."""
    spark = df.sparkSession
    fixed = spark.conf.get("spark.cofreq.buckets", None)
    if fixed:
        return int(fixed)
    n = max(spark.sparkContext.defaultParallelism, -(-n_rows // ROWS_PER_BUCKET), 1)
    return kept if n < kept <= 4 * n else n


def _kept_partitions(data: DataFrame) -> int:
    """Partitions of a persisted ``data``; 0 if it is not (asking would run it)."""
    level = data.storageLevel
    return data.rdd.getNumPartitions() if level.useMemory or level.useDisk else 0


def _hot_limit(df: DataFrame) -> int:
    """Items above which one transaction is split (``spark.cofreq.hotTransactionItems``)."""
    return int(df.sparkSession.conf.get("spark.cofreq.hotTransactionItems", None) or 100_000)


def _hot_salts(df: DataFrame) -> int:
    """Sub-keys a hot transaction is split into (``spark.cofreq.hotTransactionSplits``)."""
    return int(df.sparkSession.conf.get("spark.cofreq.hotTransactionSplits", None) or 64)


def _keep_small(df: DataFrame) -> tuple[DataFrame, int]:
    """Persist an output-sized table and count it once; the count decides
    both emptiness and whether it may be broadcast.  Its lineage is one
    aggregate over written tables, so a lost block is cheap to rebuild."""
    df = df.persist(StorageLevel.MEMORY_AND_DISK)
    return df, df.count()


def _side(df: DataFrame, n: int) -> DataFrame:
    return F.broadcast(df) if n <= BROADCAST_MAX_ROWS else df


def first_level(data: DataFrame, min_sup: int) -> Levels:
    basket = as_basket(data)
    l1, n1 = _keep_small(frequent_items(basket, min_sup))
    pruned = basket.join(_side(l1.select("item"), n1), "item", "left_semi")
    # tid-bucketed once: what joins or groups it by tid needs no exchange.  The
    # pruned basket has exactly sum(support of frequent items) rows.
    n_rows = int(l1.agg(F.sum("support")).first()[0] or 0) if n1 else 0
    n_parts = _buckets(basket, n_rows, _kept_partitions(data))
    # a repeated (tid, item) row counts once: removed inside the exchange by
    # tid; if there were any, the item supports are taken again
    pruned = bucketed_table(pruned.repartition(n_parts, "tid").dropDuplicates(["tid", "item"]), "tid", n_parts)
    if pruned.count() != n_rows:
        l1.unpersist()
        n_before = n1
        l1, n1 = _keep_small(frequent_items(pruned, min_sup))
        if n1 < n_before:  # supports only fell: as many items are the same items
            pruned = pruned.join(_side(l1.select("item"), n1), "item", "left_semi")
    item_type = pruned.schema["item"].dataType.simpleString()
    level1 = l1.select(F.col("item").cast("bigint").alias("sid"), F.array().cast(f"array<{item_type}>").alias("prefix"),
                       "item", "support")
    res = Levels(basket=pruned, min_sup=min_sup, buckets=n_parts)
    # hot transactions: an aggregate on the bucketed table (no exchange); the
    # list is counted, and broadcast only if it is small
    limit = _hot_limit(basket)
    hot = pruned.groupBy("tid").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > F.lit(limit)).select("tid")
    hot = hot.persist(StorageLevel.MEMORY_AND_DISK)
    n_hot = hot.count()
    if n_hot > 0:
        res.hot = _side(hot.select("tid"), n_hot)
    else:
        hot.unpersist()
    res.levels.append(level1)
    res.sizes.append(n1)
    res.salts.append(0)
    res.occurrences[1] = seed_occurrences(pruned)
    return res


def _new_level(counts: DataFrame, parent: DataFrame, n_parent: int, salt: int) -> DataFrame:
    """``[sid, item, support]`` of the new sets + parent table -> level table."""
    par = _side(parent.select(F.col("sid").alias("psid"), F.concat("prefix", F.array("item")).alias("prefix")),
                n_parent)
    return counts.join(par, counts["sid"] == par["psid"]).select(
        child_id("sid", "item", salt).alias("sid"), "prefix", "item", "support"
    )


def _sides(res: Levels) -> dict[int, DataFrame]:
    """The extension tables as sides of joins; one holds each set of its level once."""
    return {j: _side(ext, res.sizes[j]) for j, ext in res.extensions.items()}


def next_level(res: Levels) -> bool:
    """Add level k+1; returns False when it is empty."""
    k = res.depth
    if res.sizes[-1] == 0 or (k > 1 and res.sizes[-1] < k + 1):
        # a (k+1)-set needs k+1 frequent k-subsets (levels are always whole)
        res.exhausted = True
        return False
    if res.transactions is None:
        res.transactions = materialize(merge_transactions(res.basket))
    salts = _hot_salts(res.basket)
    tx = res.transactions if res.hot is None else split_hot(res.transactions, _hot_limit(res.basket), salts)
    ext = extend_transactions(tx, _sides(res), res.salts, k, salts)
    counts = filter_min_support(count_extensions(ext), res.min_sup).persist(StorageLevel.MEMORY_AND_DISK)
    salt = 0
    while True:
        level = _new_level(counts, res.levels[k - 1], res.sizes[k - 1], salt).persist(StorageLevel.MEMORY_AND_DISK)
        # one job: counts the new level and checks that its ids are unique
        stats = level.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("sid").alias("ids")).first()
        n = int(stats["n"])
        if n == 0:
            level.unpersist()
            counts.unpersist()
            res.exhausted = True
            return False
        if int(stats["ids"]) == n:
            break
        level.unpersist()  # 64-bit id collision: re-hash this level
        salt += 1
    res.levels.append(level)
    res.sizes.append(n)
    res.salts.append(salt)
    # written: the plans of later levels start from these tables, and each names all of them
    res.extensions[k] = materialize(counts.groupBy("sid").agg(F.array_sort(F.collect_list("item")).alias("ext")))
    counts.unpersist()
    nested = res.basket.groupBy("tid").agg(F.array_sort(F.collect_list("item")).alias("items"))
    res.occurrences[k + 1] = occurrences_of(nested, _sides(res), res.salts, k + 1)
    # only the newest occurrences are needed from here on
    res.occurrences.pop(k, None)
    return True


def apriori(data: DataFrame, min_sup: int, max_len: int | None = None) -> Levels:
    """all frequent itemsets up to ``max_len`` (None: until a level is empty)."""
    if min_sup < 1:
        raise ValueError(f"min_sup must be at least 1, not {min_sup}")
    res = first_level(data, min_sup)
    while max_len is None or res.depth < max_len:
        if not next_level(res):
            break
    return res


def adaptive_apriori(
    data: DataFrame, min_sup: int, prefix_len: int, group_limit: int | None = DEFAULT_GROUP_LIMIT
) -> Levels:
    """F1 + F7: run levels 1..p, then keep deepening while some prefix group
    of the newest level is above ``group_limit`` tids (sum of its extensions'
    supports; None: never).  The decision is one small aggregate over all
    groups."""
    res = first_level(data, min_sup)
    while True:
        k = res.depth
        if k >= prefix_len and group_limit is None:
            break
        if k >= prefix_len:
            stats = prefix_group_stats(res.levels[-1], group_limit).first()
            if not stats or (stats["n_large_groups"] or 0) == 0:
                break
        if not next_level(res):
            break
    return res
