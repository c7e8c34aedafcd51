"""Prefix groups, seeds and the two end-to-end miners.

Both miners answer in two parts, as the reference does: a *short* result
(sets up to the prefix depth) and a *long* result (sets mined inside prefix
groups).  ``mode='all'`` returns every frequent set; ``mode='forward_closed'``
returns exactly what the reference's depth-first miner reports, with ties in
the extension order broken deterministically (see ``forward_closed_rule``)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cofreq.operators.basket import frequent_items, item_rank, transpose
from cofreq.operators.condense import all_results, extension_ranks, forward_closed_rule
from cofreq.operators.levelwise import candidate_tids
from cofreq.operators.vertical import intersect_tids
from cofreq.plans.apriori import Levels, adaptive_apriori, as_basket, next_level
from cofreq.plans.groups import DEFAULT_MAX_GROUP_TIDS, Lists, group_totals, light_prefixes, mine_groups
from cofreq.plans.vertical import grow_closed, item_groups, transpose_dealt, vertical_sets
from cofreq.session import BROADCAST_MAX_ROWS, materialize, maybe_broadcast


@dataclass
class MineResult:
    short: DataFrame
    long: DataFrame
    prefix_len: int

    def all(self) -> DataFrame:
        return all_results(self.short, self.long)


def _continue(res: Levels, max_len: int | None) -> Levels:
    while (max_len is None or res.depth < max_len) and not res.exhausted and next_level(res):
        pass
    return res


def check(min_sup: int, mode: str, modes: tuple[str, ...], engine: str = "levelwise") -> None:
    if min_sup < 1:
        raise ValueError(f"min_sup must be at least 1, not {min_sup}")
    if mode not in modes:
        raise ValueError(f"unknown mode {mode!r}")
    if engine not in ("levelwise", "grouped"):
        raise ValueError(f"unknown engine {engine!r}")


def _members(fis: DataFrame, group_len: int) -> DataFrame:
    """Sets longer than the group prefix, keyed by their numeric prefix."""
    return fis.where(F.size("items") > F.lit(group_len)).select(
        F.slice("items", 1, group_len).alias("group"),
        F.slice("items", group_len + 1, F.size("items")).alias("rest"),
        "items",
        "support",
    )


def _group_extensions(fis: DataFrame, group_len: int) -> DataFrame:
    """``[group, item, support]`` for the (group_len+1)-sets."""
    return fis.where(F.size("items") == F.lit(group_len + 1)).select(
        F.slice("items", 1, group_len).alias("group"), F.element_at("items", -1).alias("item"), "support"
    )


# --------------------------------------------------------------------------
# hybrid (level-wise, then prefix groups)
# --------------------------------------------------------------------------


def prefix_groups(res: Levels, block_size: int = 1 << 16, only: DataFrame | None = None) -> DataFrame:
    """the frequent extensions of every frequent k-prefix (k = current
    depth - 1), with their tid lists per tid block:
    ``[prefix, item, support, block, tids]``; with ``only`` (``[prefix]``) those
    of the named prefixes, other occurrences being dropped before any is moved."""
    k1 = res.depth
    occ = res.occurrence_items(k1)
    ext = occ.select("tid", F.slice("items", 1, k1 - 1).alias("prefix"), F.element_at("items", -1).alias("item"))
    if only is not None:
        ext = ext.join(maybe_broadcast(only), "prefix", "left_semi")
    tids = candidate_tids(ext, block_size)
    level = res.levels[k1 - 1]
    return tids.join(level, ["prefix", "item"]).select("prefix", "item", "support", "block", "tids")


def hybrid_mine(
    data: DataFrame,
    min_sup: int,
    prefix_len: int = 1,
    mode: str = "all",
    max_len: int | None = None,
    group_limit: int | None = None,
    engine: str = "levelwise",
    split: bool = False,
    max_group_tids: int | None = None,
) -> DataFrame | MineResult:
    """levels 1..k by Apriori (k >= prefix_len, deepened by F7 while a
    prefix group is above ``group_limit`` tids); short = all frequent sets of
    length <= k; long = the sets mined in the k-prefix groups.  ``group_limit``
    is off unless asked for: it changes which groups ``forward_closed`` is
    judged in."""
    check(min_sup, mode, ("all", "forward_closed"), engine)
    res = adaptive_apriori(data, min_sup, max(1, prefix_len), group_limit)
    k = res.depth
    short = res.itemsets(1, k)
    if max_len is not None and max_len <= k:
        short = short.where(F.size("items") <= F.lit(max_len))
        out = MineResult(short, short.where(F.lit(False)), k)
        return out if split else out.all()
    if engine == "grouped":
        if res.exhausted or not next_level(res):
            long = short.where(F.lit(False))
        else:
            totals = res.levels[k].groupBy("prefix").agg(F.sum("support").cast("bigint").alias("total"))
            pairs = res.levels[1].select(F.col("prefix")[0].alias("a"), F.col("item").alias("b"))
            limit = DEFAULT_MAX_GROUP_TIDS if max_group_tids is None else max_group_tids
            n_tids = int(res.levels[0].agg(F.sum("support")).first()[0] or 0)
            groups = prefix_groups(res, only=light_prefixes(totals, limit))
            long = mine_groups(groups, min_sup, mode, max_len, limit, totals, pairs,
                               first=res.levels[k].select("prefix", "item", "support"),
                               lists=Lists(lambda: transpose_dealt(res.basket), n_tids))
    else:
        _continue(res, max_len)
        rest = materialize(res.itemsets(k + 1))
        if mode == "all":
            long = rest
        else:
            ranks = extension_ranks(_group_extensions(rest, k))
            long = forward_closed_rule(_members(rest, k), ranks, max_size=max_len).select("items", "support")
    out = MineResult(short, long, k)
    return out if split else out.all()


# --------------------------------------------------------------------------
# vertical (rank-ordered seeds, then prefix groups)
# --------------------------------------------------------------------------


def _rank_side(df: DataFrame, n: int | None) -> DataFrame:
    if n is None:
        return maybe_broadcast(df)
    return F.broadcast(df) if n <= BROADCAST_MAX_ROWS else df


def to_rank_space(basket: DataFrame, ranks: DataFrame, n_ranks: int | None = None) -> DataFrame:
    """Relabel items by their global rank; infrequent items drop out.  The
    rank table has one row per frequent item; it is broadcast only when its
    counted size allows."""
    r = _rank_side(ranks.select("item", "rank"), n_ranks)
    return basket.join(r, "item").select("tid", F.col("rank").alias("item"))


def from_rank_space(fis: DataFrame, ranks: DataFrame, n_ranks: int | None = None) -> DataFrame:
    """Map rank-space itemsets back to item ids (items ascending).  The
    rank-space array itself is the row key (itemsets are unique)."""
    r = _rank_side(ranks.select(F.col("rank").alias("r"), "item"), n_ranks)
    flat = fis.select(F.col("items").alias("_key"), "support", F.explode("items").alias("r"))
    return (
        flat.join(r, "r")
        .groupBy("_key", "support")
        .agg(F.array_sort(F.collect_list("item")).alias("items"))
        .select("items", "support")
    )


def seed_prefixes(fis_r: DataFrame, p: int) -> DataFrame:
    """seeds grown from each item over the later-ranked items up to
    length p (rank space), under the miner's rule with the closure break
    active from the first level; returns the reported sets of length 2..p."""
    members = fis_r.where((F.size("items") >= 2) & (F.size("items") <= F.lit(p))).select(
        F.slice("items", 1, 1).alias("group"),
        F.slice("items", 2, F.size("items")).alias("rest"),
        "items",
        "support",
    )
    singles = fis_r.where(F.size("items") == 1).select(F.col("items").alias("group"), "support")
    return forward_closed_rule(members, None, group_support=singles, break_from=0, max_size=p).select(
        "items", "support"
    )


def seeds_of(data: DataFrame, min_sup: int, p: int) -> DataFrame:
    """F3 end to end: rank the frequent items (W1), relabel, and grow in rank
    order with the closure break, so that skipped seeds are never extended;
    returns ``[items, support]`` in item ids."""
    basket = as_basket(data)
    ranks = item_rank(frequent_items(basket, min_sup)).persist(StorageLevel.MEMORY_AND_DISK)
    n_ranks = ranks.count()
    basket_r = to_rank_space(basket, ranks, n_ranks)
    return from_rank_space(materialize(grow_closed(*item_groups(basket_r, min_sup), min_sup, p)), ranks, n_ranks)


def vertical_mine(
    data: DataFrame,
    min_sup: int,
    prefix_len: int = 2,
    mode: str = "all",
    max_len: int | None = None,
    engine: str = "levelwise",
    split: bool = False,
    max_group_tids: int | None = None,
) -> DataFrame | MineResult:
    """sets grown from blocked tid lists.  ``forward_closed``: items ranked
    by ascending support (W1) and relabelled; seeds up to length ``p`` grown in
    rank order (F3); every rank-ordered (p-1)-prefix group over the reported
    seeds is then mined (F4) in its own ascending-support order: by growing all
    tid lists together (``engine="levelwise"``) or group by group
    (``"grouped"``).  ``p = 1`` behaves as ``p = 2``."""
    check(min_sup, mode, ("all", "forward_closed"), engine)
    p = max(2, prefix_len)
    basket = as_basket(data)
    if mode == "all":
        # every frequent set, whatever the order: no relabelling needed
        fis = vertical_sets(basket, min_sup, max_len)
        out = MineResult(fis.where(F.size("items") < p), fis.where(F.size("items") >= p), p)
        return out if split else out.all()
    ranks = item_rank(frequent_items(basket, min_sup)).persist(StorageLevel.MEMORY_AND_DISK)
    n_ranks = ranks.count()
    basket_r = to_rank_space(basket, ranks, n_ranks)
    limit = p if engine == "grouped" else max_len
    fis_r = materialize(vertical_sets(basket_r, min_sup, max(p, limit) if limit is not None else None))
    singles = fis_r.where(F.size("items") == 1)
    seeds = materialize(seed_prefixes(fis_r, p))
    short = singles.unionByName(seeds.where(F.size("items") < p))
    long_seeds = seeds.where(F.size("items") == p)
    if engine == "grouped":
        pairs = fis_r.where(F.size("items") == 2).select(F.col("items")[0].alias("a"), F.col("items")[1].alias("b"))
        limit = DEFAULT_MAX_GROUP_TIDS if max_group_tids is None else max_group_tids
        first = _seed_level(long_seeds, p - 1)
        totals = group_totals(first)
        light = long_seeds.join(first.join(light_prefixes(totals, limit), "prefix", "left_semi").select(
            F.concat("prefix", F.array("item")).alias("items")), "items", "left_semi")
        n_tids = int(singles.agg(F.sum("support")).first()[0] or 0)
        long = mine_groups(vertical_groups(basket_r, light, p - 1), min_sup, mode, max_len, limit, totals, pairs,
                           first=first, lists=Lists(lambda: transpose_dealt(basket_r), n_tids))
    else:
        ranks_g = extension_ranks(_group_extensions(long_seeds, p - 1))
        members = _members(fis_r if max_len is None else fis_r.where(F.size("items") <= max_len), p - 1)
        long = forward_closed_rule(members, ranks_g, max_size=max_len).select("items", "support")
    if max_len is not None:
        short, long = (d.where(F.size("items") <= max_len) for d in (short, long))
    out = MineResult(from_rank_space(short, ranks, n_ranks), from_rank_space(long, ranks, n_ranks), p)
    return out if split else out.all()


def _seed_level(long_seeds: DataFrame, group_len: int) -> DataFrame:
    """Seeds as ``[prefix, item, support]``."""
    return long_seeds.select(F.slice("items", 1, group_len).alias("prefix"), F.element_at("items", -1).alias("item"), "support")


def vertical_groups(basket_r: DataFrame, long_seeds: DataFrame, group_len: int, block_size: int = 1 << 16) -> DataFrame:
    """Prefix groups of the vertical miner: each reported seed ``Q ∪ {x}``
    with the tids of the whole seed, by intersecting blocked item tid lists
    (J4)."""
    tids = intersect_tids(long_seeds.select("items"), transpose(basket_r, block_size))
    return tids.join(long_seeds, "items").select(
        F.slice("items", 1, group_len).alias("prefix"), F.element_at("items", -1).alias("item"), "support", "block", "tids")
