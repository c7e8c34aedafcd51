"""File round trips (S1-S5, K1-K7) and encoder properties."""

import pytest
from conftest import as_map, tx_df
from pyspark.sql import functions as F

from cofreq.operators import basket as B
from cofreq.plans.apriori import apriori
from cofreq.plans.miners import hybrid_mine
from cofreq.sources import readers as R
from cofreq.sources import writers as W

ROWS = [[1, 2, 3]] * 4 + [[1, 4, 5, 6, 7], [2, 4, 5, 6, 7], [3, 4, 5, 6, 7], [4, 5, 6, 7]] + [[1, 3, 7]] * 4 + [[2, 6]] * 2


@pytest.fixture(scope="module")
def fis(spark):
    return apriori(tx_df(spark, ROWS), 2).itemsets().persist()


def test_encode_decode(spark, fis):
    enc = W.encode_itemsets(fis)
    assert as_map(R.decode_itemsets(W.encoded_lines(enc))) == as_map(fis)
    # tiny lines: every line must still decode on its own
    enc2 = W.encode_itemsets(fis, max_sets=3)
    assert enc2.count() > enc.count()
    assert as_map(R.decode_itemsets(W.encoded_lines(enc2))) == as_map(fis)


def test_encoded_files(spark, fis, tmp_path):
    W.write_encoded(fis, str(tmp_path / "enc"))
    assert as_map(R.read_encoded(spark, str(tmp_path / "enc"))) == as_map(fis)
    with pytest.raises(Exception):
        W.write_encoded(fis, str(tmp_path / "enc"))  # refuses to overwrite by default


def test_itemset_table(spark, fis, tmp_path):
    W.write_itemset_table(fis, str(tmp_path / "t"))
    assert as_map(R.read_itemset_table(spark, str(tmp_path / "t"))) == as_map(fis)


def test_itemset_text(spark):
    df = spark.createDataFrame([([1, 2, 3], 12)], "items array<int>, support bigint")
    assert W.itemset_lines(df).first()["value"] == "1 2 3 (12)"


def test_short_encoding(spark):
    level = spark.createDataFrame([([1, 2], 3, 5), ([1, 2], 4, 6), ([], 7, 9)], "prefix array<int>, item int, support bigint")
    got = sorted((r["n"], r["encoded"]) for r in W.encode_short_itemsets(level).collect())
    assert got == [(1, "7(9)"), (2, "1|2|3(5)$4(6)")]


def test_vertical_files(spark, tmp_path):
    tx = tx_df(spark, [[1, 2, 3, 4], [1, 4, 5, 7], [3, 5, 6], [4, 7]])
    v = B.transpose(B.explode_items(tx), block_size=2)
    assert v.count() > 7  # blocked rows
    W.write_vertical(v, str(tmp_path / "v"))
    back = R.read_vertical(spark, str(tmp_path / "v"), block_size=2)
    sup = {r["item"]: r["support"] for r in B.vertical_supports(back).collect()}
    assert sup == {1: 2, 2: 1, 3: 2, 4: 3, 5: 2, 6: 1, 7: 2}


def test_result_table(spark, tmp_path):
    m = hybrid_mine(tx_df(spark, ROWS), 4, prefix_len=1, mode="forward_closed", split=True)
    W.write_result(m.short, m.long, str(tmp_path / "r"))
    back = R.read_result(spark, str(tmp_path / "r"))
    assert as_map(back.where(F.col("kind") == "short")) == as_map(m.short)
    assert as_map(back.where(F.col("kind") == "long")) == as_map(m.long)
    assert as_map(back) == {**as_map(m.short), **as_map(m.long)}


def test_encoded_total_and_release(spark, fis):
    from cofreq.session import Run

    enc = W.encode_itemsets(fis, max_sets=4)
    assert W.encoded_total(enc).first()["n_itemsets"] == fis.count()
    with Run(spark) as run:
        res = apriori(tx_df(spark, ROWS), 2)
        n = res.itemsets().count()
        res.release()
        mine = list(run.tables)
        assert len(mine) >= 2
    assert not {t.name for t in spark.catalog.listTables()}.intersection(mine)
    assert n == fis.count()


def test_live_runs_keep_their_files(spark, tmp_path):
    """Of two live runs one is released; the other's lazy result is whole."""
    import os

    from cofreq.session import Run, drop_intermediate_tables

    one, two = Run(spark), Run(spark)
    results = []
    for run in (one, two):
        run.open()
        results.append(hybrid_mine(tx_df(spark, ROWS), 2, mode="forward_closed"))
        run.close()
    want = as_map(results[1])
    paths = list(one.paths)
    assert paths and one.release() > 0 and not any(os.path.exists(p.removeprefix("file:")) for p in paths)
    drop_intermediate_tables(spark)  # what belongs to no run; not the second run's
    spark.catalog.clearCache()
    assert as_map(results[1]) == want and want
    # runs nest: the inner one owns what is written inside it
    with Run(spark) as outer:
        with Run(spark) as inner:
            apriori(tx_df(spark, ROWS), 2).release()
            assert inner.tables and not outer.tables
        W.write_itemset_table(apriori(tx_df(spark, ROWS), 2).itemsets(), str(tmp_path / "kept"))
        assert outer.tables and not inner.tables
    assert R.read_itemset_table(spark, str(tmp_path / "kept")).count() == len(as_map(apriori(tx_df(spark, ROWS), 2).itemsets()))
    assert two.release() > 0
