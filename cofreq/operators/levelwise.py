"""Level-wise (Apriori-style) operators.

Occurrences are rows ``[tid, psid, sid, last]``: one row per frequent
k-itemset per transaction holding it.  They are grown by one item per level
with an equi-join of siblings on ``(tid, psid)``, so both parents of a
candidate are frequent, both sides stay co-partitioned by ``tid``, and the only
shuffle per level is the partially-aggregated ``(set, item)`` count.
Candidates are therefore the combinations that actually occur together; no
pairing of all members of a prefix group is ever emitted.

For counting alone no occurrence is shuffled or written: ``extend_transactions``
grows the sets again inside each transaction, by joins with the small tables of
frequent extensions, and only counts leave the task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cofreq.functions.itemsets import last_item, prefix_of, tid_block
from cofreq.session import maybe_broadcast

DEFAULT_GROUP_LIMIT = 175_000_000  # tids per prefix group (1e9 / 4 * 0.7)


def seed_occurrences(basket: DataFrame) -> DataFrame:
    """Level-1 occurrences ``[tid, psid, sid, last]``: a single item's id is the
    item, its parent is the empty set (0)."""
    return basket.select("tid", F.lit(0).cast("bigint").alias("psid"), F.col("item").cast("bigint").alias("sid"),
                         F.col("item").alias("last"))


def _siblings(occ: DataFrame, other: DataFrame, *keys: str) -> DataFrame:
    o, b = occ.alias("o"), other.alias("b")
    same = [F.col(f"o.{k}") == F.col(f"b.{k}") for k in ("tid", "psid", *keys)]
    cond = F.col("b.last") > F.col("o.last")
    for c in same:
        cond = cond & c
    return o.join(b, cond).select(F.col("o.tid").alias("tid"), F.col("o.sid").alias("sid"), F.col("b.last").alias("item"))


def extend_occurrences(occ: DataFrame) -> DataFrame:
    """J2 core: occurrences of two siblings (same transaction, same parent set)
    are joined -> ``[tid, sid, item]``: ``S ∪ {item}`` for both of whose parents
    the transaction is an occurrence.  The table is bucketed by ``tid``, which
    is part of the join key, so with
    ``spark.sql.requireAllClusterKeysForCoPartition`` off the join needs no
    exchange."""
    occ.sparkSession.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    return _siblings(occ, occ)


def child_id(parent: str = "sid", item: str = "item", salt: int = 0):
    """Id of the set ``parent ∪ {item}``."""
    return F.xxhash64(F.col(parent), F.col(item), F.lit(salt))


def merge_transactions(basket: DataFrame) -> DataFrame:
    """``[tid, item]`` -> ``[items, n]``: items ascending, equal transactions
    once with their number."""
    return basket.groupBy("tid").agg(F.array_sort(F.collect_list("item")).alias("items")).groupBy("items").agg(
        F.count(F.lit(1)).alias("n"))


def split_hot(tx: DataFrame, limit: int, salts: int) -> DataFrame:
    """``[items, ..., _salt]``: transactions of over ``limit`` items once for
    each of ``salts`` sub-keys; a sub-key takes its share of the first items of
    the sets, so every set of such a transaction is grown exactly once, and by
    ``salts`` tasks instead of one.  For the others ``_salt`` is null."""
    hot = tx.where(F.size("items") > limit).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    cold = tx.where(F.size("items") <= limit).withColumn("_salt", F.lit(None).cast("int"))
    return cold.unionByName(hot.repartition(salts))


def _grown(rows: DataFrame, keep: list[str], level: int, to_come: int, salt: int, salts: int) -> DataFrame:
    """One row ``[keep.., psid, sid, item, rest]`` for each item in ``rest`` that
    has ``to_come`` items behind it, which are the new ``rest``; the set ``sid``
    grows to one of ``level`` items."""
    start = F.slice("rest", 1, F.greatest(F.size("rest") - to_come, F.lit(0)))
    split = level == 1 and "_salt" in rows.columns
    out = rows.select(*keep, "sid", "rest", *(["_salt"] if split else []), F.posexplode(start).alias("_at", "item"))
    if split:
        out = out.where(F.col("_salt").isNull() | (F.pmod("_at", F.lit(salts)) == F.col("_salt")))
    sid = F.col("item").cast("bigint") if level == 1 else child_id("sid", "item", salt)
    return out.select(*keep, F.col("sid").alias("psid"), sid.alias("sid"), "item",
                      F.slice("rest", F.col("_at") + 2, F.size("rest")).alias("rest"))


def _projected(tx: DataFrame, keep: list[str], extensions: dict[int, DataFrame], ids: list[int], k: int, size: int,
               salts: int) -> DataFrame:
    """``[keep.., sid, rest]``: for every frequent (k-1)-set in a transaction
    the items there that extend it to a frequent k-set, if sets of ``size``
    items can come of them."""
    rows = tx.withColumn("sid", F.lit(0).cast("bigint")).withColumnRenamed("items", "rest")
    for j in range(1, k):
        rows = _grown(rows, keep, j, size - j, ids[j - 1], salts).join(extensions[j], "sid").select(
            *keep, "sid", F.array_intersect("rest", "ext").alias("rest"))
    return rows


def extend_transactions(tx: DataFrame, extensions: dict[int, DataFrame], ids: list[int], k: int, salts: int = 64) -> DataFrame:
    """J2 inside each transaction of ``[items, n]`` (items ascending): ``[n, sid,
    item]`` for each k-set ``sid`` and later item in it, both of whose parents
    (the k-set, and its sibling with that item) are frequent.

    ``extensions[j]`` is ``[sid, ext]``, the items that extend a frequent j-set
    to a frequent (j+1)-set, for j < k (with a broadcast hint if small: then
    nothing is shuffled); ``ids[j-1]`` is the salt of the ids of j-sets.  With a
    column ``_salt`` (``split_hot``) a transaction is grown by several tasks."""
    rows = _grown(_projected(tx, ["n"], extensions, ids, k, k + 1, salts), ["n"], k, 1, ids[k - 1], salts)
    return rows.select("n", "sid", F.explode("rest").alias("item"))


def occurrences_of(tx: DataFrame, extensions: dict[int, DataFrame], ids: list[int], k: int) -> DataFrame:
    """Occurrences ``[tid, psid, sid, last]`` of the frequent k-sets in ``[tid,
    items]``, partitioned as that is."""
    rows = _grown(_projected(tx, ["tid"], extensions, ids, k, k, 1), ["tid"], k, 0, ids[k - 1], 1)
    return rows.select("tid", "psid", "sid", F.col("item").alias("last"))


def count_extensions(ext: DataFrame) -> DataFrame:
    """A2: support of each (set id, item); Catalyst plans a partial
    (map-side) and a final hash aggregate over fixed-width keys, so a hot key
    is pre-combined before the shuffle.  A row counts ``n`` times if it has that."""
    n = F.sum("n").cast("bigint") if "n" in ext.columns else F.count(F.lit(1))
    return ext.groupBy("sid", "item").agg(n.alias("support"))


def filter_min_support(df: DataFrame, min_sup: int, col: str = "support") -> DataFrame:
    """``support >= min_sup`` (absolute, inclusive)."""
    return df.where(F.col(col) >= F.lit(min_sup))


def level_to_itemsets(level: DataFrame) -> DataFrame:
    """``[(sid,) prefix, item, support]`` -> ``[items, support]``."""
    return level.select(F.concat("prefix", F.array("item")).alias("items"), "support")


def itemsets_to_level(itemsets: DataFrame) -> DataFrame:
    """``[items, support]`` -> ``[prefix, item, support]`` (P5)."""
    return itemsets.select(
        prefix_of("items").alias("prefix"), last_item("items").alias("item"), "support"
    )


def generate_candidates(occ_items: DataFrame, basket: DataFrame, level: DataFrame) -> DataFrame:
    """(k+1)-candidates ``[prefix, item]`` joining two frequent k-sets that
    share their first k-1 items (``prefix + [a]`` and ``prefix + [item]``),
    restricted to combinations that occur in at least one transaction.
    Combinations that never co-occur have support 0 and are never counted, so
    this is the reference's candidate set minus its support-0 members.
    ``occ_items`` is ``[tid, items]``; ``level`` is ``[prefix, item, ...]``."""
    o = occ_items.alias("o")
    b = basket.alias("b")
    ext = o.join(b, (F.col("o.tid") == F.col("b.tid")) & (F.col("b.item") > last_item(F.col("o.items")))).select(
        F.col("o.items").alias("prefix"), F.col("b.item").alias("item"))
    # the second parent: S[:-1] + [item] must be frequent
    parent = level.select(F.concat("prefix", F.array("item")).alias("_p2"))
    return (
        ext.distinct()
        .withColumn("_p2", F.concat(prefix_of("prefix"), F.array("item")))
        .join(maybe_broadcast(parent), "_p2", "left_semi")
        .drop("_p2")
    )


def candidate_tids(ext: DataFrame, block_size: int = 1 << 16) -> DataFrame:
    """Tid lists of each (prefix, item), per tid block (bounded rows)."""
    return (
        ext.withColumn("block", tid_block("tid", block_size))
        .groupBy("prefix", "item", "block")
        .agg(F.array_sort(F.collect_list("tid")).alias("tids"))
    )


def prefix_group_stats(level: DataFrame, limit: int = DEFAULT_GROUP_LIMIT) -> DataFrame:
    """A5: per prefix the sum of its extensions' supports; then the number of
    groups and of groups above ``limit`` (one row)."""
    totals = level.groupBy("prefix").agg(F.sum("support").cast("bigint").alias("total"))
    return totals.agg(
        F.count(F.lit(1)).alias("n_groups"),
        F.count_if(F.col("total") > F.lit(limit)).alias("n_large_groups"),
        F.max("total").alias("max_total"),
    )


def max_candidates(level: DataFrame) -> DataFrame:
    """n(n-1)/2 candidates a prefix group of n frequent extensions can
    produce (a count, nothing is enumerated)."""
    return level.groupBy("prefix").agg(F.count(F.lit(1)).alias("n_extensions")).withColumn(
        "max_candidates", (F.col("n_extensions") * (F.col("n_extensions") - 1) / 2).cast("bigint")
    )
