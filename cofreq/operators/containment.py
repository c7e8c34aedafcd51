"""J2 and J3 for a given candidate table: support and tid lists of itemsets that
the caller names, by a set-containment join.

A candidate is keyed by its rarest item; a transaction probes with those of its
items that are keys, so a pair meets only if the transaction holds the
candidate's rarest item, and is kept if it holds the others too.  The pairs
under a key number (transactions with the item) x (candidates under it): where
that passes ``PAIRS_PER_TASK`` the transactions are dealt into slots by a hash of
their id and the candidates repeated in each slot.  Transactions are cut down to
items that occur in candidates before anything is shuffled.

Defined results: a candidate is a set (order and repeated items do not count, the
answer has it sorted) and is answered once; one that no transaction holds has
support 0; the empty one is held by every transaction; null items and null
candidates are ignored; repeated (tid, item) rows count once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cofreq.functions.itemsets import tid_block
from cofreq.operators.basket import baskets, explode_items
from cofreq.session import materialize, maybe_broadcast

PAIRS_PER_TASK = 20_000_000
MAX_SLOTS = 4_096


def _as_sets(candidates: DataFrame) -> DataFrame:
    return candidates.where(F.col("items").isNotNull()).select(
        F.array_sort(F.array_distinct(F.array_compact("items"))).alias("items")).distinct()


def holders(data: DataFrame, candidates: DataFrame) -> DataFrame:
    """``[items, tid]``: the transactions that hold each non-empty candidate.
    ``data`` is ``[tid, items]`` or ``[tid, item]``; ``candidates`` is ``[items]``."""
    basket = explode_items(data) if "items" in data.columns else data.select("tid", "item")
    wanted = _as_sets(candidates).where(F.size("items") > 0)
    flat = wanted.select("items", F.explode("items").alias("item"))
    used = maybe_broadcast(flat.select("item").distinct())
    basket = materialize(basket.join(used, "item", "left_semi").dropDuplicates(["tid", "item"]))
    support = basket.groupBy("item").agg(F.count(F.lit(1)).alias("support"))
    # a candidate with an item that never occurs has no rarest item that does
    rarest = flat.join(maybe_broadcast(support), "item", "left").groupBy("items").agg(
        F.min(F.struct(F.coalesce("support", F.lit(0)).alias("support"), "item")).alias("rare"))
    keyed = materialize(rarest.where(F.col("rare.support") > 0).select("items", F.col("rare.item").alias("key"), "rare.support"))
    keys = keyed.groupBy("key").agg(F.least(F.lit(MAX_SLOTS), F.ceil(
        F.first("support") * F.count(F.lit(1)) / F.lit(PAIRS_PER_TASK))).cast("int").alias("slots"))
    keys = maybe_broadcast(materialize(keys))
    left = keyed.join(keys, "key").select("key", "items", F.explode(F.sequence(F.lit(0), F.col("slots") - 1)).alias("slot"))
    tx = baskets(basket).withColumnRenamed("items", "held")
    probes = tx.select("tid", "held", F.explode("held").alias("key")).join(keys, "key").select(
        "key", F.pmod(F.xxhash64("tid"), F.col("slots")).cast("int").alias("slot"), "tid", "held")
    return probes.join(left, ["key", "slot"]).where(F.size(F.array_except("items", "held")) == 0).select("items", "tid")


def _held_by_all(candidates: DataFrame) -> bool:
    """Whether the empty candidate is among them."""
    return candidates.where(F.size("items") == 0).limit(1).count() > 0


def count_candidates(data: DataFrame, candidates: DataFrame) -> DataFrame:
    """``[items, support]`` of every candidate, support 0 included."""
    whole = _as_sets(candidates)
    counted = holders(data, candidates).groupBy("items").agg(F.count(F.lit(1)).alias("support"))
    n_tx = data.select("tid").distinct().count() if _held_by_all(whole) else 0
    return whole.join(counted, "items", "left").select("items", F.when(F.size("items") == 0, F.lit(n_tx)).otherwise(
        F.coalesce("support", F.lit(0))).cast("bigint").alias("support"))


def candidate_tid_lists(data: DataFrame, candidates: DataFrame, block_size: int = 1 << 16) -> DataFrame:
    """``[items, block, tids]``, the tids of every candidate for each block of
    tids; one row with a null block and no tids for a candidate that no
    transaction holds.  The empty candidate is held by all transactions."""
    whole = _as_sets(candidates)
    found = holders(data, candidates)
    if _held_by_all(whole):
        none = F.array().cast(whole.schema["items"].dataType).alias("items")
        found = found.unionByName(data.select("tid").distinct().select(none, "tid"))
    lists = found.groupBy("items", tid_block("tid", block_size).alias("block")).agg(F.array_sort(F.collect_list("tid")).alias("tids"))
    return whole.join(lists, "items", "left").select(
        "items", "block", F.coalesce("tids", F.array().cast("array<bigint>")).cast("array<bigint>").alias("tids"))
