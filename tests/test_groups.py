"""Heavy groups, wrong arguments, repeated rows and long item ids."""

import random

import pytest
from pyspark.sql import functions as F

from conftest import as_map, brute_force, tx_df
from cofreq import frequent_itemsets
from cofreq.plans.apriori import apriori
from cofreq.plans.miners import hybrid_mine, vertical_mine

TEN = [[1, 2, 3, 4]] * 10


@pytest.mark.parametrize("limit", [0, 15, 25, 10**9])
def test_heavy_groups_lose_nothing(spark, limit):
    tx = tx_df(spark, TEN)
    every = brute_force(TEN, 5)
    assert as_map(hybrid_mine(tx, 5, mode="all", engine="grouped", max_group_tids=limit)) == every
    expect = as_map(hybrid_mine(tx, 5, mode="forward_closed"))
    assert as_map(hybrid_mine(tx, 5, mode="forward_closed", engine="grouped", max_group_tids=limit)) == expect
    vertical = as_map(vertical_mine(tx, 5, mode="forward_closed"))
    assert "1 2 3 4" in vertical
    assert as_map(vertical_mine(tx, 5, mode="forward_closed", engine="grouped", max_group_tids=limit)) == vertical


@pytest.mark.parametrize("seed", range(3))
def test_heavy_and_light_agree(spark, seed):
    rnd = random.Random(seed)
    rows = [[i for i in range(7) if rnd.random() < 0.55] for _ in range(40)]
    tx = tx_df(spark, [r for r in rows if r])
    for mine, kw in ((hybrid_mine, {"prefix_len": 1}), (vertical_mine, {"prefix_len": 3})):
        plain = as_map(mine(tx, 5, mode="forward_closed", **kw))
        for limit in (0, 40):
            assert as_map(mine(tx, 5, mode="forward_closed", engine="grouped", max_group_tids=limit, **kw)) == plain


def test_repeated_rows_count_once(spark):
    rows = spark.createDataFrame([(0, 1), (0, 1), (0, 2), (1, 1), (1, 2), (2, 3), (2, 3)], "tid bigint, item int")
    assert as_map(apriori(rows, 2).itemsets()) == {"1": 2, "2": 2, "1 2": 2}
    assert as_map(vertical_mine(rows, 2)) == {"1": 2, "2": 2, "1 2": 2}


def test_long_item_ids(spark):
    big = 5_000_000_000
    rows = [[big, big + 1, big + 2], [big, big + 1], [big + 1, big + 2]]
    data = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "tid bigint, items array<bigint>")
    expect = brute_force(rows, 2)
    assert as_map(hybrid_mine(data, 2)) == expect
    assert as_map(hybrid_mine(data, 2, engine="grouped")) == expect
    assert as_map(vertical_mine(data, 2)) == expect


def test_wrong_arguments_raise(spark):
    tx = tx_df(spark, TEN)
    for kw in ({"method": "no_such_method"}, {"mode": "no_such_mode"}, {"max_len": 0},
               {"method": "apriori", "engine": "grouped"}, {"engine": "no_such_engine"}):
        with pytest.raises(ValueError):
            frequent_itemsets(tx, 5, **kw)
    for method in ("hybrid", "vertical"):
        with pytest.raises(TypeError):
            frequent_itemsets(tx, 5, method=method, no_such_option=1)
    for mine in (hybrid_mine, vertical_mine, apriori):
        with pytest.raises(ValueError):
            mine(tx, 0)


def test_answer_does_not_depend_on_size(spark):
    """The depth is raised only when asked for."""
    tx = tx_df(spark, TEN)
    assert as_map(hybrid_mine(tx, 5, mode="forward_closed")) == as_map(hybrid_mine(tx, 5, mode="forward_closed", group_limit=None))
    assert as_map(hybrid_mine(tx, 5, mode="all", group_limit=20)) == brute_force(TEN, 5)


def test_integer_blocks(spark):
    from cofreq.functions.itemsets import tid_block

    got = spark.createDataFrame([(0,), (9,), (10,), (-1,), (2**62 + 1,)], "tid bigint").select(tid_block("tid", 10).alias("b"))
    assert [r["b"] for r in got.collect()] == [0, 0, 1, -1, (2**62 + 1) // 10]
    assert got.where(F.col("b").isNull()).count() == 0


def test_intermediates_leave_no_files(spark):
    import os

    from cofreq.session import ensure_checkpoint_dir, drop_intermediate_tables

    assert as_map(vertical_mine(tx_df(spark, TEN), 5)) and as_map(apriori(tx_df(spark, TEN), 5).itemsets())
    assert drop_intermediate_tables(spark) > 0
    base = ensure_checkpoint_dir(spark).removeprefix("file:")
    left = [f for d, _, names in os.walk(base) for f in names if "/tables/" in d + "/" or "/cofreq-files" in d]
    assert not left
