"""Work that stays inside a block of tids: what is shuffled grows with the
basket, not with the number of sets times their lists."""

import random
import re

from pyspark.sql import functions as F

from conftest import tx_df
from cofreq.operators import basket as B
from cofreq.operators import vertical as V


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _diff_group(spark, rows, block, scale=1):
    basket = B.explode_items(tx_df(spark, rows)).select((F.col("tid") * scale).alias("tid"), "item")
    lists = V.by_block(B.transpose(basket, block))
    own = lists.select(F.col("item").alias("p"), "block", F.col("tids").alias("tp"))
    other = lists.select("item", "block", F.col("tids").alias("tx"))
    sizes = B.item_supports(basket)
    level = basket.alias("x").join(basket.alias("y"), "tid").where("x.item < y.item").groupBy(
        F.col("x.item").alias("p"), F.col("y.item").alias("item")).agg(F.count(F.lit(1)).alias("support"))
    group = own.join(F.broadcast(level), "p").join(other.hint("shuffle_hash"), ["item", "block"], "left").select(
        F.array("p").alias("prefix"), "item", "support", "block",
        F.array_except("tp", F.coalesce("tx", F.array().cast("array<bigint>"))).alias("diff"))
    pairs = level.alias("a").join(level.alias("b"), F.expr("a.p = b.p AND a.item < b.item")).select(
        F.array("a.p").alias("prefix"), F.col("a.item").alias("a"), F.col("b.item").alias("b"))
    assert sizes.count()
    return group, pairs


def test_diffsets_of_a_block_are_not_moved(spark):
    rnd = random.Random(7)
    rows = [[i for i in range(6) if rnd.random() < 0.5] for _ in range(60)]
    for block, scale in ((8, 1), (1 << 40, 10**9)):  # tids side by side, and far apart
        found = V.diffset_extend(*_diff_group(spark, rows, block, scale))
        got = {(r["prefix"][0], r["a"], r["b"]): r["support"] for r in found.collect()}
        assert got and all(n == sum({p, a, b} <= set(t) for t in rows) for (p, a, b), n in got.items())
    # no exchange by prefix carries diffsets: only sizes go on
    assert not re.search(r"Exchange hashpartitioning\(prefix#\d+, (b|block)#", _plan(found))


def test_levels_write_no_occurrences(spark, monkeypatch):
    """Only the pruned basket is written by tid, however many levels there are;
    transactions that are equal are counted by their number."""
    from conftest import as_map, brute_force
    from cofreq.plans import apriori as A

    rows = [[1, 2, 3, 4]] * 5 + [[2, 3, 4, 5]] * 2 + [[1, 5]]
    written, plain = [], A.bucketed_table
    monkeypatch.setattr(A, "bucketed_table", lambda *a, **k: written.append(1) or plain(*a, **k))
    res = A.apriori(tx_df(spark, rows), 2)
    assert res.depth == 4 and len(written) == 1
    assert sorted((r["items"], r["n"]) for r in res.transactions.collect()) == [([1, 2, 3, 4], 5), ([1, 5], 1), ([2, 3, 4, 5], 2)]
    assert as_map(res.itemsets()) == brute_force(rows, 2)
