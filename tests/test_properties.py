"""Random small inputs: every miner equals brute force in ``all`` mode, the
two forward-closed engines agree, and the condensed sets nest."""

import random

import pytest
from conftest import as_map, brute_force, tx_df

from cofreq.operators import condense as C
from cofreq.plans.apriori import apriori
from cofreq.plans.api import frequent_itemsets
from cofreq.plans.miners import hybrid_mine, vertical_mine


def random_rows(seed, n=30, items=8):
    rnd = random.Random(seed)
    return [sorted(rnd.sample(range(1, items + 1), rnd.randint(1, 6))) for _ in range(n)]


@pytest.mark.parametrize("seed", [1])
def test_miners_match_brute_force(spark, seed):
    rows = random_rows(seed)
    tx = tx_df(spark, rows)
    expect = brute_force(rows, 4)
    assert as_map(apriori(tx, 4).itemsets()) == expect
    assert as_map(hybrid_mine(tx, 4, prefix_len=2)) == expect
    assert as_map(vertical_mine(tx, 4, prefix_len=2)) == expect
    assert as_map(hybrid_mine(tx, 4, prefix_len=1, engine="grouped")) == expect


@pytest.mark.parametrize("seed", [4])
def test_forward_closed_engines_agree(spark, seed):
    rows = random_rows(seed, n=25, items=7)
    tx = tx_df(spark, rows)
    for p in (1, 2):
        a = as_map(hybrid_mine(tx, 3, prefix_len=p, mode="forward_closed"))
        b = as_map(hybrid_mine(tx, 3, prefix_len=p, mode="forward_closed", engine="grouped"))
        assert a == b
    a = as_map(vertical_mine(tx, 3, prefix_len=3, mode="forward_closed"))
    b = as_map(vertical_mine(tx, 3, prefix_len=3, mode="forward_closed", engine="grouped"))
    assert a == b
    allm = as_map(apriori(tx, 3).itemsets())
    closed = as_map(C.closed_only(apriori(tx, 3).itemsets()))
    assert set(closed) <= set(a) <= set(allm)


def test_facade_and_fpgrowth(spark):
    from pyspark.ml.fpm import FPGrowth

    rows = random_rows(7, n=40)
    tx = tx_df(spark, rows)
    ours = as_map(frequent_itemsets(tx, 5))
    model = FPGrowth(itemsCol="items", minSupport=(5 - 0.5) / len(rows)).fit(tx)
    theirs = {" ".join(map(str, sorted(r["items"]))): r["freq"] for r in model.freqItemsets.collect()}
    assert ours == theirs
    closed = as_map(frequent_itemsets(tx, 5, mode="closed", max_len=2))
    assert all(len(k.split()) <= 2 for k in closed)
    assert as_map(frequent_itemsets(tx, 5, mode="maximal")) == as_map(C.maximal_only(apriori(tx, 5).itemsets()))


def test_adaptive_depth_keeps_all(spark):
    rows = random_rows(11, n=40)
    tx = tx_df(spark, rows)
    m = hybrid_mine(tx, 4, prefix_len=1, group_limit=5, split=True)
    assert m.prefix_len > 1  # groups were too big at depth 1
    assert as_map(m.all()) == brute_force(rows, 4)


def test_hot_transactions_are_split(spark):
    """Transactions above the hot limit take the salted join; the result must
    not change."""
    rows = random_rows(5, n=30) + [list(range(1, 9))] * 3
    tx = tx_df(spark, rows)
    spark.conf.set("spark.cofreq.hotTransactionItems", "5")
    spark.conf.set("spark.cofreq.hotTransactionSplits", "3")
    try:
        from cofreq.plans.apriori import first_level

        assert first_level(tx, 4).hot is not None
        assert as_map(apriori(tx, 4).itemsets()) == brute_force(rows, 4)
    finally:
        spark.conf.unset("spark.cofreq.hotTransactionItems")
        spark.conf.unset("spark.cofreq.hotTransactionSplits")
