"""The depth-first miner of a prefix group: rows, memory at its limit, sets
visited, and the emitters."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import as_map, brute_force, tx_df
from cofreq.plans.apriori import apriori
from cofreq.plans.depthfirst import DepthFirst
from cofreq.plans.groups import mine_groups
from cofreq.plans.miners import hybrid_mine, prefix_groups


def walk(lists, order, min_sup, max_items, closed):
    """The search as a plain recursion over whole tid sets."""
    out = {}

    def below(chosen, tids, siblings, own):
        for k, (x, mine) in enumerate(siblings):
            grown = (*chosen, x)
            nxt = [(y, mine & t) for y, t in siblings[k + 1:] if len(mine & t) >= min_sup] if len(grown) < max_items else []
            if not closed or not any(len(t) == len(mine) for _, t in nxt):
                out[grown] = len(mine)
            below(grown, mine, nxt, len(mine))
            if closed and len(grown) < max_items and len(mine) == own:
                break

    below((), None, [(x, set(t.tolist())) for x, t in zip(order, lists) if len(t) >= min_sup], None)
    return out


@pytest.mark.parametrize("seed", range(60))
def test_same_sets_as_a_plain_recursion(seed):
    rnd = random.Random(seed)
    n, m = rnd.randint(1, 30), rnd.randint(1, 8)
    lists = [np.array([t for t in range(n) if rnd.random() < rnd.choice((0.3, 0.6, 0.95))], np.int64) * 7 for _ in range(m)]
    order = rnd.sample(range(100), m)
    min_sup, room = rnd.randint(1, 4), rnd.choice((1, 2, 3, 99))
    for closed in (False, True):
        want = walk(lists, order, min_sup, room, closed)
        for budget in (0, 40, 1 << 26):
            search = DepthFirst(order, lists, min_sup, room, closed, budget)
            assert {tuple(c): s for c, s in search.sets()} == want
            assert search.held == 0


def test_memory_stays_within_the_budget():
    """What the search holds beside the group's lists never passes the budget by
    more than the tid lists of one path, at budgets from nothing to plenty."""
    rng = np.random.default_rng(2)
    lists = sorted((np.flatnonzero(rng.random(4000) < p) for p in np.linspace(0.75, 0.97, 13)), key=len)
    group = 4 * sum(map(len, lists))
    counts = set()
    for budget in (0, group // 8, group, 1 << 30):
        search = DepthFirst(list(range(13)), lists, 1200, budget=budget)
        counts.add(sum(1 for _ in search.sets()))
        assert search.peak <= budget + group
    assert len(counts) == 1 and counts.pop() > 2000
    wide = DepthFirst(list(range(13)), lists, 1200, budget=1 << 30)
    sum(1 for _ in wide.sets())
    assert wide.peak < group  # diffsets of dense lists are small


def test_the_break_visits_fewer_sets():
    """A dense group: the closure break never lists all frequent sets."""
    rnd = random.Random(4)
    rows = [frozenset(i for i in range(14) if i < 9 and t % 3 or rnd.random() < 0.5) for t in range(90)]
    lists = sorted((np.array([t for t, r in enumerate(rows) if i in r], np.int64) for i in range(14)), key=len)
    every, closed = (DepthFirst(list(range(14)), lists, 20, closed=c) for c in (False, True))
    n_every, n_closed = len(list(every.sets())), len(list(closed.sets()))
    assert every.grown == n_every and closed.grown < n_every / 2 and n_closed <= closed.grown


@pytest.mark.parametrize("limit", [0, 30, 10**9])
def test_lengths_without_sets(spark, limit):
    rnd = random.Random(8)
    rows = [[i for i in range(8) if rnd.random() < 0.6] for _ in range(50)]
    res = apriori(tx_df(spark, [r for r in rows if r]), 8, 2)
    groups = prefix_groups(res)
    for mode in ("all", "forward_closed"):
        sets = mine_groups(groups, 8, mode, max_group_tids=limit)
        want = {r["k"]: r["n"] for r in sets.groupBy(F.size("items").alias("k")).agg(F.count("*").alias("n")).collect()}
        got = {r["length"]: r["n"] for r in mine_groups(groups, 8, mode, max_group_tids=limit, emit="lengths").collect()}
        assert got == want and want
    with pytest.raises(ValueError):
        mine_groups(groups, 8, emit="nothing")


def test_small_budget_end_to_end(spark):
    rnd = random.Random(3)
    rows = [[i for i in range(9) if rnd.random() < 0.7] for _ in range(60)]
    tx = tx_df(spark, [r for r in rows if r])
    every = brute_force(rows, 12)
    assert as_map(hybrid_mine(tx, 12, engine="grouped")) == every
    groups = prefix_groups(apriori(tx, 12, 2))
    found = as_map(mine_groups(groups, 12, "all", budget=0))
    assert found == {k: v for k, v in every.items() if " " in k}
