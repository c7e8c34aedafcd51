"""Sets counted in slots of tids: no level writes or moves a tid list."""

import random

import pytest

from conftest import as_map, brute_force, tx_df
from cofreq.operators import slots
from cofreq.plans import miners, vertical
from cofreq.plans.apriori import as_basket


def _rows(seed, n=60, items=7):
    rnd = random.Random(seed)
    rows = [[i for i in range(items) if rnd.random() < 0.55] for _ in range(n)]
    return [r for r in rows if r]


@pytest.mark.parametrize(("block", "scale"), [(8, 1), (1 << 16, 10**9)])
def test_many_slots_and_rounds(spark, monkeypatch, block, scale):
    monkeypatch.setattr(slots, "TIDS_PER_SLOT", 20)
    monkeypatch.setattr(slots, "SETS_AT_ONCE", 25)
    monkeypatch.setattr(slots, "WORDS_AT_ONCE", 1)
    rows = _rows(3) + [[90]] * 5 + [[91, 90]] * 2  # lists that are short beside their slot
    basket = as_basket(tx_df(spark, rows)).selectExpr(f"tid * {scale} AS tid", "item")
    assert as_map(vertical.vertical_sets(basket, 2, block_size=block)) == brute_force(rows, 2)


def test_levels_write_no_lists(spark, monkeypatch):
    rows = _rows(4, 30, 5)
    sets, lists = vertical.item_groups(as_basket(tx_df(spark, rows)), 2, 8)
    written, dealt = [], []
    plain, deal = vertical.materialize, slots.bucketed_table
    monkeypatch.setattr(vertical, "materialize", lambda df: written.append(df.columns) or plain(df))
    monkeypatch.setattr(slots, "bucketed_table", lambda *a: dealt.append(1) or deal(*a))
    assert as_map(vertical.grow(sets, lists, 2)) == brute_force(rows, 2)
    assert len(dealt) == 1 and len(written) > 3 and not any("tids" in c for c in written)


@pytest.mark.parametrize("mine", [miners.hybrid_mine, miners.vertical_mine])
def test_heavy_groups_have_no_lists(spark, monkeypatch, mine):
    rows, given, plain = _rows(5, 30, 5), [], miners.mine_groups
    monkeypatch.setattr(miners, "mine_groups", lambda groups, *a, **k: given.append(groups) or plain(groups, *a, **k))
    tx = tx_df(spark, rows)
    got = as_map(mine(tx, 3, mode="forward_closed", engine="grouped", max_group_tids=0))
    assert given[0].count() == 0 and got == as_map(mine(tx, 3, mode="forward_closed"))


def test_longest_is_the_first_level(spark):
    rows = [[1, 2, 3]] * 3
    assert as_map(vertical.vertical_sets(as_basket(tx_df(spark, rows)), 2, 1)) == {"1": 3, "2": 3, "3": 3}
    assert as_map(vertical.vertical_sets(as_basket(tx_df(spark, rows)), 4)) == {}
