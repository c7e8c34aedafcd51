"""Seeds grown with the closure break against the rule over all frequent sets."""

import random

import pytest
from pyspark.sql import functions as F

from conftest import as_map, tx_df
from cofreq.plans import vertical
from cofreq.plans.apriori import as_basket
from cofreq.plans.miners import seed_prefixes
from cofreq.plans.vertical import grow_closed, item_groups, vertical_sets


@pytest.mark.parametrize(("seed", "p"), [(1, 2), (2, 3), (3, 4)])
def test_same_seeds_as_the_rule(spark, seed, p):
    rnd = random.Random(seed)
    rows = [[i for i in range(7) if rnd.random() < 0.55 or (i > 4 and 2 in t)] for t in ([rnd.randrange(4)] for _ in range(24))]
    basket = as_basket(tx_df(spark, rows))
    want = as_map(seed_prefixes(vertical_sets(basket, 3, p), p))
    assert want and as_map(grow_closed(*item_groups(basket, 3, block_size=8), 3, p)) == want


def test_skipped_siblings_are_not_grown(spark, monkeypatch):
    """Six items that always occur together: the break leaves one path a start."""
    basket = as_basket(tx_df(spark, [[1, 2, 3, 4, 5, 6]] * 5))
    grown, plain = [], vertical.next_lists
    monkeypatch.setattr(vertical, "next_lists", lambda *a: grown.append(plain(*a)) or grown[-1])
    found = as_map(grow_closed(*item_groups(basket, 2), 2, 6))
    assert found == as_map(seed_prefixes(vertical_sets(basket, 2, 6), 6))
    # after the pairs, only the first extension of a set goes on
    assert sum(d.select("sid").distinct().count() for d in grown[:5]) < 2 ** 6 - 1 - 6


def test_no_seeds(spark):
    empty = tx_df(spark, [[1]]).select("tid", F.explode("items").alias("item")).where(F.lit(False))
    assert grow_closed(*item_groups(empty, 1), 1, 3).count() == 0
