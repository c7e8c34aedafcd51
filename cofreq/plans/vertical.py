"""Vertical mining over blocked tid lists.

A level is two tables: the sets ``[sid, prefix, item, support]`` and their tid
lists ``[sid, psid, item, block, tids]``, one row for each block of tids, so
no row or task grows with the number of transactions.  The next level joins
siblings (same parent ``psid``), intersects their lists block by block and adds
the sizes up over the blocks.  Only siblings whose last items form a frequent
pair are joined, which keeps groups of many siblings from being paired off."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cofreq.functions.itemsets import tid_block, tids_intersect
from cofreq.operators.slots import count_pairs, count_sets, deal
from cofreq.session import materialize, maybe_broadcast

ROWS_PER_TASK = 500_000  # (tid, item) rows that are transposed at once
ROOT = 0  # id of the empty set


def set_id(parent: str, item: str):
    return F.xxhash64(F.col(parent), F.col(item))


def seed_groups(groups: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Prefix groups ``[prefix, item, support, block, tids]`` as a first level."""
    named = groups.withColumn("psid", F.xxhash64("prefix")).withColumn("sid", set_id("psid", "item"))
    sets = named.select("sid", "prefix", "item", "support").distinct()
    return sets, named.select("sid", "psid", "item", "block", "tids")


def item_lists(lists: DataFrame) -> DataFrame:
    """Blocked lists ``[item, block, tids]`` as lists of single items."""
    named = lists.select(F.lit(ROOT).cast("bigint").alias("psid"), "item", "block", "tids")
    return named.select(set_id("psid", "item").alias("sid"), "psid", "item", "block", "tids")


def path_sets(first: DataFrame) -> DataFrame:
    """Prefix groups ``[prefix, item, support]`` as a first level whose sets are
    intersections of the lists of their items."""
    own = lambda x: F.xxhash64(F.lit(ROOT).cast("bigint"), x)
    named = first.withColumn("psid", F.xxhash64("prefix")).withColumn("sid", set_id("psid", "item"))
    return named.select("sid", "prefix", "item", "support",
                        F.transform(F.concat("prefix", F.array("item")), own).alias("path"))


def frequent_pairs(lists: DataFrame, min_sup: int) -> DataFrame:
    """Item pairs ``[a, b]`` that are frequent together under some parent,
    counted where they occur together (pairs that never do are not formed)."""
    rows = lists.select("psid", "item", F.explode("tids").alias("tid"))
    other = rows.select("psid", "tid", F.col("item").alias("b"))
    return rows.select("psid", "tid", F.col("item").alias("a")).join(other, ["psid", "tid"]).where(
        F.col("a") < F.col("b")).groupBy("psid", "a", "b").agg(F.count(F.lit(1)).alias("n")).where(
        F.col("n") >= min_sup).select("a", "b").distinct()


def next_lists(lists: DataFrame, pairs: DataFrame, siblings: DataFrame | None = None) -> DataFrame:
    """J4 for all siblings: ``[sid, psid, item, block, tids]`` of the sets one
    item longer (``psid`` is the sibling that was extended).  ``siblings`` are
    the sets to extend with, where not all of them are extended themselves."""
    siblings = lists if siblings is None else siblings
    first = lists.select(F.col("sid").alias("first"), "psid", F.col("item").alias("a"), "block", F.col("tids").alias("ta"))
    second = siblings.select("psid", F.col("item").alias("b"), "block", F.col("tids").alias("tb"))
    both = first.join(pairs.select("a", "b"), "a").join(second, ["psid", "block", "b"])
    shared = both.select(F.col("first").alias("psid"), F.col("b").alias("item"), "block",
                         tids_intersect("ta", "tb").alias("tids")).where(F.size("tids") > 0)
    return shared.select(set_id("psid", "item").alias("sid"), "psid", "item", "block", "tids")


def grow(sets: DataFrame, lists: DataFrame, min_sup: int, max_len: int | None = None,
         pairs: DataFrame | None = None, n_tids: int | None = None) -> DataFrame:
    """All frequent sets grown from a first level: ``[items, support]``, the
    first level included.

    The lists are dealt out by block once and never written again: each level
    intersects them anew in their slots (``operators.slots``) and adds the counts
    up.  ``sets`` may have a column ``path``, the lists that a set is the
    intersection of (otherwise its own); the last of them is the one that its
    siblings are extended by.  ``n_tids`` is the number of entries of the lists
    where that is not the sum of the supports of ``sets``."""
    if "path" not in sets.columns:
        sets = sets.withColumn("path", F.array("sid"))
    sets = materialize(sets.select("sid", F.xxhash64("prefix").alias("psid"), "prefix", "item", "support", "path"))
    n, total = sets.agg(F.count(F.lit(1)), F.sum("support")).first()
    levels = [sets] if n else []
    first = sets.select(F.size("prefix").alias("k")).limit(1).collect()
    length = first[0]["k"] + 1 if first else 0
    if first and max_len is not None and length > max_len:
        levels = []
    elif first and (max_len is None or length < max_len):
        dealt, slots = deal(lists, int(total) if n_tids is None else n_tids)
        pairs = materialize(count_pairs(dealt, min_sup) if pairs is None else pairs.select("a", "b"))
    while first and n > 1 and (max_len is None or length < max_len):
        one = sets.select(F.col("sid").alias("parent"), "psid", F.col("item").alias("a"))
        two = sets.select("psid", F.col("item").alias("b"), F.element_at("path", -1).alias("id"))
        wanted = one.join(pairs, "a").join(two, ["psid", "b"]).groupBy("parent").agg(F.collect_list("id").alias("ids"))
        wanted = wanted.join(sets.select(F.col("sid").alias("parent"), "path"), "parent").select(
            F.col("parent").alias("psid"), "path", "ids")
        often = count_sets(dealt, slots, wanted, n).where(F.col("support") >= min_sup)
        own = sets.select(F.col("sid").alias("parent"), F.col("psid").alias("group"), F.col("path").alias("up"),
                          F.concat("prefix", F.array("item")).alias("above"))
        named = two.select(F.col("psid").alias("group"), "id", F.col("b").alias("item"))
        found = often.withColumnRenamed("psid", "parent").join(own, "parent").join(named, ["group", "id"])
        longer = materialize(found.select(set_id("parent", "item").alias("sid"), F.col("parent").alias("psid"),
                                          F.col("above").alias("prefix"), "item", "support",
                                          F.concat("up", F.array("id")).alias("path")))
        n, names = longer.agg(F.count(F.lit(1)), F.count_distinct("sid")).first()
        if n == 0:
            break
        if n != names:
            raise ArithmeticError("two sets share a 64-bit id")
        levels.append(longer)
        sets, length = longer, length + 1
    return reduce(DataFrame.unionByName, levels or [sets.where(F.lit(False))]).select(
        F.concat("prefix", F.array("item")).alias("items"), "support")


def grow_closed(sets: DataFrame, lists: DataFrame, min_sup: int, max_len: int) -> DataFrame:
    """The sets of 2 to ``max_len`` items that the forward-closed search reports
    from a first level of single items, whose values are the order of the
    search: ``[items, support]``.

    The closure break is part of the growth: where an extension has the support
    of its set, the siblings after it are not extended (they still extend those
    before them).  A set is reported if no extension has its support; sets of
    ``max_len`` items are not extended, so they neither break nor are tested."""
    sets, lists = materialize(sets), materialize(lists)
    pairs = materialize(frequent_pairs(lists, min_sup))
    visited, reported, length = sets, [sets.where(F.lit(False))], 1
    while length < max_len:
        extended = lists if length == 1 else lists.join(visited.select("sid"), "sid", "left_semi")
        found = materialize(next_lists(extended, pairs, lists))
        often = found.groupBy("sid", "psid", "item").agg(F.sum(F.size("tids")).cast("bigint").alias("support")).where(
            F.col("support") >= min_sup)
        parent = visited.select(F.col("sid").alias("psid"), F.concat("prefix", F.array("item")).alias("prefix"),
                                F.col("support").alias("own"))
        longer = materialize(often.join(parent, "psid").select("sid", "psid", "prefix", "item", "support", "own"))
        n, names = longer.agg(F.count(F.lit(1)), F.count_distinct("sid")).first()
        if n != names:
            raise ArithmeticError("two sets share a 64-bit id")
        equal = longer.where(F.col("support") == F.col("own")).groupBy("psid").agg(F.min("item").alias("last"))
        if length > 1:
            reported.append(visited.join(equal.select(F.col("psid").alias("sid")), "sid", "left_anti"))
        length += 1
        if n == 0:
            break
        if length == max_len:
            reported.append(longer)
            break
        visited = materialize(longer.join(equal, "psid", "left").where(
            F.col("last").isNull() | (F.col("item") <= F.col("last"))).drop("last"))
        lists = materialize(found.join(longer.select("sid"), "sid", "left_semi"))
    return reduce(DataFrame.unionByName, [r.select(F.concat("prefix", F.array("item")).alias("items"), "support")
                                          for r in reported])


def transpose_dealt(basket: DataFrame, block_size: int = 1 << 16) -> DataFrame:
    """A3 with the rows dealt out by block first, as many at a time as a task
    can hold, so that lists are put together where they stay."""
    n = max(basket.sparkSession.sparkContext.defaultParallelism, -(-basket.count() // ROWS_PER_TASK))
    rows = basket.select("item", "tid", tid_block("tid", block_size).alias("block")).repartition(n, "block")
    return rows.groupBy("item", "block").agg(F.array_sort(F.collect_set("tid")).alias("tids")).select(
        "item", "block", F.size("tids").cast("bigint").alias("support"), "tids")


def item_groups(basket: DataFrame, min_sup: int, block_size: int = 1 << 16) -> tuple[DataFrame, DataFrame]:
    """First level of a long basket ``[tid, item]``: its frequent items."""
    item_type = basket.schema["item"].dataType.simpleString()
    lists = materialize(transpose_dealt(basket, block_size))
    often = lists.groupBy("item").agg(F.sum("support").alias("support")).where(F.col("support") >= min_sup)
    none = F.array().cast(f"array<{item_type}>")
    groups = lists.drop("support").join(maybe_broadcast(often), "item").select(none.alias("prefix"), "item", "support", "block", "tids")
    return seed_groups(groups)


def vertical_sets(basket: DataFrame, min_sup: int, max_len: int | None = None, block_size: int = 1 << 16) -> DataFrame:
    """All frequent sets of a long basket ``[tid, item]`` by tid lists."""
    return grow(*item_groups(basket, min_sup, block_size), min_sup, max_len)
