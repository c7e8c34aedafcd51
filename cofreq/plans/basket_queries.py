"""Registered queries over the order basket (see README, "Queries").

Every query reads the whole TPC-H-style tables and builds the basket of
``cofreq.sources.basket``; the support threshold scales with the data:
``min_sup = ceil(n_baskets / 150)``."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cofreq.functions.itemsets import itemset_string, tid_block
from cofreq.operators import basket as B
from cofreq.operators import condense as C
from cofreq.operators import containment as N
from cofreq.operators import levelwise as L
from cofreq.operators import vertical as V
from cofreq.plans.api import frequent_itemsets
from cofreq.plans.apriori import apriori, first_level, next_level
from cofreq.plans.groups import mine_groups
from cofreq.plans.miners import hybrid_mine, prefix_groups as _prefix_groups, vertical_mine
from cofreq.sources import readers as R
from cofreq.sources import writers as W
from cofreq.session import ensure_checkpoint_dir, maybe_broadcast
from cofreq.sources.basket import order_basket

SUPPORT_DIVISOR = 150
BLOCK = 1 << 16
MIN_LENGTH = 6
GROUP_LIMIT_LOW = 2_000
STATS_LIMIT = 3_000
GROUPED_LIMIT = 10_000

_KEPT: list[DataFrame] = []


@dataclass
class Ctx:
    basket: DataFrame
    tx: DataFrame
    n: int
    min_sup: int


def ctx(spark: SparkSession, sf_dir: str) -> Ctx:
    # queries are independent: release the basket an earlier one kept
    while _KEPT:
        _KEPT.pop().unpersist()
    basket = order_basket(spark, sf_dir).persist()
    _KEPT.append(basket)
    tx = B.baskets(basket)  # nested form, only for the parsing/length queries
    n = basket.select("tid").distinct().count()
    return Ctx(basket, tx, n, -(-n // SUPPORT_DIVISOR))


def _text(fis: DataFrame) -> DataFrame:
    return C.as_text(fis)


def _tids(col: str = "tids"):
    return itemset_string(F.array_sort(col))


# -- sources / basket -------------------------------------------------------

def q_parse_transactions(spark, sf_dir):
    c = ctx(spark, sf_dir)
    # lines written the other way round with a doubled delimiter: the parser
    # must sort, and must skip the empty tokens
    lines = c.tx.select("tid", F.array_join(F.transform(F.reverse("items"), lambda x: x.cast("string")), "  ").alias("value"))
    parsed = R.parse_transactions(lines, " ")
    return parsed.select("tid", itemset_string("items").alias("itemset"))


def q_transaction_count(spark, sf_dir):
    return B.transaction_count(ctx(spark, sf_dir).tx)


def q_frequent_items(spark, sf_dir):
    c = ctx(spark, sf_dir)
    return B.frequent_items(c.basket, c.min_sup)


def q_prune_items(spark, sf_dir):
    c = ctx(spark, sf_dir)
    pruned = B.prune_items(c.basket, B.frequent_items(c.basket, c.min_sup))
    return B.baskets(pruned).select("tid", itemset_string("items").alias("itemset"))


def q_filter_min_length(spark, sf_dir):
    c = ctx(spark, sf_dir)
    return B.filter_min_length(c.tx, MIN_LENGTH).select("tid", F.size("items").alias("n_items"))


def q_item_rank(spark, sf_dir):
    c = ctx(spark, sf_dir)
    r = B.item_rank(B.frequent_items(c.basket, c.min_sup))
    return r.select("item", "support", F.col("rank").cast("bigint").alias("rank"))


def q_transpose(spark, sf_dir):
    c = ctx(spark, sf_dir)
    v = B.transpose(c.basket, BLOCK)
    return v.select("item", "block", "support", _tids().alias("tids"))


def q_merge_tids(spark, sf_dir):
    c = ctx(spark, sf_dir)
    # partial lists as separate splits would produce them, each within a block
    partial = (
        c.basket.withColumn("part", (F.col("tid") % 4).cast("int")).withColumn("block", tid_block("tid", BLOCK))
        .groupBy("item", "part", "block").agg(F.collect_list("tid").alias("tids"))
    )
    m = B.merge_tids(partial, ("item",), BLOCK)
    return m.select("item", "block", F.size("tids").cast("bigint").alias("support"), _tids().alias("tids"))


# -- level-wise building blocks --------------------------------------------

def _two_levels(c: Ctx):
    res = first_level(c.basket, c.min_sup)
    next_level(res)
    return res


def q_generate_candidates(spark, sf_dir):
    c = ctx(spark, sf_dir)
    res = _two_levels(c)
    cands = L.generate_candidates(res.occurrence_items(2), res.basket, res.levels[1])
    return cands.select(itemset_string(F.concat("prefix", F.array("item"))).alias("itemset"))


def q_max_candidates(spark, sf_dir):
    c = ctx(spark, sf_dir)
    res = _two_levels(c)
    return L.max_candidates(res.levels[1]).select(
        itemset_string("prefix").alias("prefix"), "n_extensions", "max_candidates"
    )


def q_candidate_support(spark, sf_dir):
    c = ctx(spark, sf_dir)
    res = _two_levels(c)
    ext = L.extend_occurrences(res.occurrences[2])
    counts = L.count_extensions(ext)
    parents = res.levels[1].select("sid", F.concat("prefix", F.array("item")).alias("pitems"))
    return counts.join(parents, "sid").select(
        itemset_string(F.concat("pitems", F.array("item"))).alias("itemset"), "support")


def q_candidate_tids(spark, sf_dir):
    c = ctx(spark, sf_dir)
    res = _two_levels(c)
    occ = res.occurrence_items(2)
    ext = occ.select("tid", F.slice("items", 1, 1).alias("prefix"), F.element_at("items", -1).alias("item"))
    t = L.candidate_tids(ext, BLOCK)
    return t.select(itemset_string(F.concat("prefix", F.array("item"))).alias("itemset"), "block", _tids().alias("tids"))


def _named_candidates(spark, sf_dir) -> DataFrame:
    """Candidates that the data does not propose: each part's brand with its
    suppliers' nations; and every such nation with the next region over, which
    no transaction holds."""
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    sold = read("lineitem").select("l_partkey", "l_suppkey").distinct()
    brand = read("part").select(F.col("p_partkey").alias("l_partkey"), F.regexp_extract("p_brand", r"(\d+)$", 1).try_cast("int").alias("brand"))
    place = read("supplier").join(read("nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(
        F.col("s_suppkey").alias("l_suppkey"), (F.col("n_nationkey") + 100).cast("int").alias("nation"),
        ((F.col("n_regionkey") + 1) % 5 + 200).cast("int").alias("next_region"))
    both = sold.join(brand, "l_partkey").join(place, "l_suppkey").where(F.col("brand").isNotNull())
    return both.select(F.explode(F.array(F.array("nation", "brand"), F.array("next_region", "nation"))).alias("items")).distinct()


def q_containment_support(spark, sf_dir):
    """J2 for a given candidate table, with candidates of support 0."""
    return N.count_candidates(ctx(spark, sf_dir).basket, _named_candidates(spark, sf_dir)).select(
        itemset_string("items").alias("itemset"), "support")


def q_containment_tids(spark, sf_dir):
    """J3 for a given candidate table, with candidates without tids."""
    t = N.candidate_tid_lists(ctx(spark, sf_dir).basket, _named_candidates(spark, sf_dir), BLOCK)
    return t.select(itemset_string("items").alias("itemset"), "block", _tids().alias("tids"))


def q_grouped_length_counts(spark, sf_dir):
    """Sets of each length counted while the prefix groups are mined; no
    set is handed over."""
    c = ctx(spark, sf_dir)
    found = mine_groups(_prefix_groups(_two_levels(c), BLOCK), c.min_sup, "all", emit="lengths")
    return found.select(F.col("length").cast("int").alias("level"), "n")


def q_prefix_groups(spark, sf_dir):
    c = ctx(spark, sf_dir)
    res = _two_levels(c)
    g = _prefix_groups(res, BLOCK)
    return g.select(itemset_string("prefix").alias("prefix"), "item", "support", "block", _tids().alias("tids"))


def _frequent_pairs(c: Ctx) -> DataFrame:
    res = _two_levels(c)
    return L.level_to_itemsets(res.levels[1])


def q_intersect_tids(spark, sf_dir):
    c = ctx(spark, sf_dir)
    pairs = _frequent_pairs(c)
    v = B.transpose(c.basket, BLOCK)
    t = V.intersect_tids(pairs.select("items"), v)
    return t.select(itemset_string("items").alias("itemset"), "block", _tids().alias("tids"))


def q_diff_tids(spark, sf_dir):
    c = ctx(spark, sf_dir)
    pairs = _frequent_pairs(c).select(F.col("items")[0].alias("a"), F.col("items")[1].alias("b"))
    v = B.transpose(c.basket, BLOCK)
    d = V.diffset_support(pairs, v)
    return d.select(itemset_string(F.array("a", "b")).alias("itemset"), "support", "diff_size")


def q_prefix_group_stats(spark, sf_dir):
    c = ctx(spark, sf_dir)
    res = _two_levels(c)
    return L.prefix_group_stats(res.levels[1], STATS_LIMIT)


# -- miners -----------------------------------------------------------------

def q_apriori(spark, sf_dir):
    c = ctx(spark, sf_dir)
    return _text(apriori(c.basket, c.min_sup).itemsets())


def q_vertical_mine(spark, sf_dir):
    c = ctx(spark, sf_dir)
    return _text(vertical_mine(c.basket, c.min_sup, prefix_len=2, mode="all"))


def q_hybrid_mine(spark, sf_dir):
    c = ctx(spark, sf_dir)
    return _text(hybrid_mine(c.basket, c.min_sup, prefix_len=2, mode="all"))


def q_seed_prefixes(spark, sf_dir):
    """the vertical miner's seeds of length 2..3 (rank order, closure
    break from the first level), mapped back to item ids."""
    from cofreq.plans.miners import seeds_of

    c = ctx(spark, sf_dir)
    return _text(seeds_of(c.basket, c.min_sup, 3))


def q_closed_itemsets(spark, sf_dir):
    c = ctx(spark, sf_dir)
    return _text(C.closed_only(apriori(c.basket, c.min_sup).itemsets()))


def q_maximal_itemsets(spark, sf_dir):
    c = ctx(spark, sf_dir)
    return _text(C.maximal_only(apriori(c.basket, c.min_sup).itemsets()))


def q_forward_closed_itemsets(spark, sf_dir):
    c = ctx(spark, sf_dir)
    return _text(hybrid_mine(c.basket, c.min_sup, prefix_len=1, mode="forward_closed"))


def q_adaptive_depth(spark, sf_dir):
    c = ctx(spark, sf_dir)
    return _text(hybrid_mine(c.basket, c.min_sup, prefix_len=1, mode="all", group_limit=GROUP_LIMIT_LOW))


def q_length_counts(spark, sf_dir):
    c = ctx(spark, sf_dir)
    return C.length_counts(apriori(c.basket, c.min_sup).itemsets())


def q_itemset_total(spark, sf_dir):
    c = ctx(spark, sf_dir)
    return C.itemset_total(apriori(c.basket, c.min_sup).itemsets())


def q_all_results(spark, sf_dir):
    c = ctx(spark, sf_dir)
    m = hybrid_mine(c.basket, c.min_sup, prefix_len=2, mode="forward_closed", split=True)
    return _text(C.all_results(m.short, m.long))


def q_encode_short_itemsets(spark, sf_dir):
    """K2 for the sets of every length."""
    c = ctx(spark, sf_dir)
    return W.encode_short_itemsets(W.split_prefix(apriori(c.basket, c.min_sup).itemsets()), 10)


def q_encoded_lines(spark, sf_dir):
    """K1, the text itself, with one set to a line."""
    c = ctx(spark, sf_dir)
    fis = apriori(c.basket, c.min_sup).itemsets()
    return W.encoded_lines(W.encode_itemsets(fis, 1))


def q_encode_decode_roundtrip(spark, sf_dir):
    c = ctx(spark, sf_dir)
    fis = apriori(c.basket, c.min_sup).itemsets()
    lines = W.encoded_lines(W.encode_itemsets(fis))
    return _text(R.decode_itemsets(lines))


def q_itemset_text(spark, sf_dir):
    c = ctx(spark, sf_dir)
    return W.itemset_lines(apriori(c.basket, c.min_sup).itemsets())


def q_vertical_forward_closed(spark, sf_dir):
    c = ctx(spark, sf_dir)
    return _text(vertical_mine(c.basket, c.min_sup, prefix_len=3, mode="forward_closed"))


def q_grouped_forward_closed(spark, sf_dir):
    """F4 through the grouped (applyInPandas) engine; equals the rule."""
    c = ctx(spark, sf_dir)
    return _text(hybrid_mine(c.basket, c.min_sup, prefix_len=1, mode="forward_closed", engine="grouped"))


def q_grouped_all(spark, sf_dir):
    """F4 grouped engine in ``all`` mode with a group limit low enough that
    the heaviest groups are grown from their blocked tid lists."""
    c = ctx(spark, sf_dir)
    m = hybrid_mine(c.basket, c.min_sup, prefix_len=1, mode="all", engine="grouped", split=True,
                    max_group_tids=GROUPED_LIMIT)
    return _text(m.all())


def q_grouped_all_heavy(spark, sf_dir):
    """F4 with every group above the limit."""
    c = ctx(spark, sf_dir)
    return _text(hybrid_mine(c.basket, c.min_sup, prefix_len=1, mode="all", engine="grouped", max_group_tids=0))


def q_grouped_vertical_forward_closed(spark, sf_dir):
    """F5 grouped, every group above the limit."""
    c = ctx(spark, sf_dir)
    return _text(vertical_mine(c.basket, c.min_sup, prefix_len=3, mode="forward_closed", engine="grouped", max_group_tids=0))


def q_duplicate_rows(spark, sf_dir):
    """A long basket that holds every row twice: a duplicated item counts once."""
    c = ctx(spark, sf_dir)
    return _text(apriori(c.basket.unionAll(c.basket), c.min_sup).itemsets())


def q_facade_closed_max_len(spark, sf_dir):
    """F8 with P4: closed sets of at most two items."""
    c = ctx(spark, sf_dir)
    return _text(frequent_itemsets(c.basket, c.min_sup, mode="closed", method="vertical", max_len=2))


def q_diffset_extend(spark, sf_dir):
    """J5 below the first level: in the group of every item, the sets of three
    items from the diffsets of its frequent pairs."""
    c = ctx(spark, sf_dir)
    res = _two_levels(c)
    level = res.levels[1].select(F.col("prefix")[0].alias("p"), "item", "support")
    # the lists are dealt out by block once; pairs of them meet inside a block
    lists = V.by_block(B.transpose(c.basket, BLOCK))
    own = lists.select(F.col("item").alias("p"), "block", F.col("tids").alias("tp"))
    other = lists.select("item", "block", F.col("tids").alias("tx"))
    group = own.join(maybe_broadcast(level), "p").join(other.hint("shuffle_hash"), ["item", "block"], "left").select(
        F.array("p").alias("prefix"), "item", "support", "block",
        F.array_except("tp", F.coalesce("tx", F.array().cast("array<bigint>"))).alias("diff"))
    a = level.select("p", F.col("item").alias("a"))
    b = level.select("p", F.col("item").alias("b"))
    both = level.select(F.col("p").alias("a"), F.col("item").alias("b"))  # pairs of siblings that are frequent
    pairs = a.join(both, "a").join(b, ["p", "b"]).select(F.array("p").alias("prefix"), "a", "b")
    found = V.diffset_extend(group, pairs).where(F.col("support") > 0)
    return found.select(itemset_string(F.concat("prefix", F.array("a", "b"))).alias("itemset"), "support")


def _deep(spark, sf_dir):
    """A denser basket: items are the low digits of what an order holds, so
    that sets of five and more items are frequent."""
    c = ctx(spark, sf_dir)
    low = F.when(F.col("item") < 100, F.col("item") % 4).when(F.col("item") < 200, 10 + F.col("item") % 3).when(
        F.col("item") < 300, 20 + F.col("item") % 2).otherwise(30 + F.col("item") % 2)
    # a fifth family that the first implies, so that supports repeat
    implied = c.basket.where(F.col("item") < 100).select("tid", (40 + F.floor(F.col("item") % 4 / 2)).alias("item"))
    dense = c.basket.select("tid", low.cast("bigint").alias("item")).unionAll(implied)
    return dense, -(-c.n // 50)


def q_apriori_deep(spark, sf_dir):
    return _text(apriori(*_deep(spark, sf_dir)).itemsets())


def q_vertical_deep(spark, sf_dir):
    return _text(vertical_mine(*_deep(spark, sf_dir)))


def q_closed_deep(spark, sf_dir):
    return _text(C.closed_only(apriori(*_deep(spark, sf_dir)).itemsets()))


def q_forward_closed_deep(spark, sf_dir):
    return _text(hybrid_mine(*_deep(spark, sf_dir), prefix_len=1, mode="forward_closed", engine="grouped"))


def _scratch(spark) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/files-{uuid.uuid4().hex[:12]}"


def q_transaction_files(spark, sf_dir):
    """Transactions written as text and read back, with fresh ids."""
    c = ctx(spark, sf_dir)
    path = _scratch(spark)
    c.tx.select(itemset_string("items").alias("value")).write.text(path)
    got = R.read_transactions(spark, path)
    return got.groupBy(itemset_string("items").alias("itemset")).agg(F.count_distinct("tid").alias("n"))


def q_itemset_table_files(spark, sf_dir):
    """K4, S3: the table of sets written and read back."""
    c = ctx(spark, sf_dir)
    path = _scratch(spark)
    W.write_itemset_table(apriori(c.basket, c.min_sup).itemsets(), path)
    return _text(R.read_itemset_table(spark, path))


def q_vertical_files(spark, sf_dir):
    """Tid lists written and read back."""
    c = ctx(spark, sf_dir)
    path = _scratch(spark)
    W.write_vertical(B.transpose(c.basket, BLOCK), path)
    return R.read_vertical(spark, path, BLOCK).select("item", "block", "support", _tids().alias("tids"))


def q_result_files(spark, sf_dir):
    """K6: the short and the long result as one table, read back."""
    c = ctx(spark, sf_dir)
    path = _scratch(spark)
    m = hybrid_mine(c.basket, c.min_sup, prefix_len=2, mode="all", split=True)
    W.write_result(m.short, m.long, path)
    return R.read_result(spark, path).select(itemset_string("items").alias("itemset"), "support", F.col("kind").cast("string"))


QUERIES = {
    "parse_transactions": q_parse_transactions,
    "transaction_count": q_transaction_count,
    "frequent_items": q_frequent_items,
    "prune_items": q_prune_items,
    "filter_min_length": q_filter_min_length,
    "item_rank": q_item_rank,
    "transpose": q_transpose,
    "merge_tids": q_merge_tids,
    "generate_candidates": q_generate_candidates,
    "max_candidates": q_max_candidates,
    "candidate_support": q_candidate_support,
    "candidate_tids": q_candidate_tids,
    "containment_support": q_containment_support,
    "containment_tids": q_containment_tids,
    "grouped_length_counts": q_grouped_length_counts,
    "prefix_groups": q_prefix_groups,
    "intersect_tids": q_intersect_tids,
    "diff_tids": q_diff_tids,
    "prefix_group_stats": q_prefix_group_stats,
    "apriori": q_apriori,
    "vertical_mine": q_vertical_mine,
    "hybrid_mine": q_hybrid_mine,
    "seed_prefixes": q_seed_prefixes,
    "closed_itemsets": q_closed_itemsets,
    "maximal_itemsets": q_maximal_itemsets,
    "forward_closed_itemsets": q_forward_closed_itemsets,
    "adaptive_depth": q_adaptive_depth,
    "length_counts": q_length_counts,
    "itemset_total": q_itemset_total,
    "all_results": q_all_results,
    "encode_short_itemsets": q_encode_short_itemsets,
    "encode_decode_roundtrip": q_encode_decode_roundtrip,
    "itemset_text": q_itemset_text,
    "vertical_forward_closed": q_vertical_forward_closed,
    "grouped_forward_closed": q_grouped_forward_closed,
    "grouped_all": q_grouped_all,
    "grouped_all_heavy": q_grouped_all_heavy,
    "grouped_vertical_forward_closed": q_grouped_vertical_forward_closed,
    "duplicate_rows": q_duplicate_rows,
    "facade_closed_max_len": q_facade_closed_max_len,
    "diffset_extend": q_diffset_extend,
    "apriori_deep": q_apriori_deep,
    "vertical_deep": q_vertical_deep,
    "closed_deep": q_closed_deep,
    "forward_closed_deep": q_forward_closed_deep,
    "encoded_lines": q_encoded_lines,
    "transaction_files": q_transaction_files,
    "itemset_table_files": q_itemset_table_files,
    "vertical_files": q_vertical_files,
    "result_files": q_result_files,
}
