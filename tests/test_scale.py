"""What one task holds does not grow with the input."""

from cofreq.plans import apriori as A
from cofreq.sources import basket as S

DIR = "/root/testdata/sf0.001"


def _largest(df):
    return max(df.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect())


def test_basket_is_dealt_out_before_it_is_held(spark, monkeypatch):
    want = sorted(map(tuple, S.order_basket(spark, DIR).collect()))
    monkeypatch.setattr(S, "ROWS_PER_PARTITION", 500)
    basket = S.order_basket(spark, DIR)
    rows = spark.read.parquet(f"{DIR}/lineitem.parquet").count()
    assert basket.rdd.getNumPartitions() >= rows // 500 and _largest(basket) < 1000
    assert sorted(map(tuple, basket.collect())) == want
    # the pairs are exchanged once, by tid, and no hash table is filled before that
    plan = S.order_basket(spark, DIR)._jdf.queryExecution().executedPlan().toString()
    above, below = plan.split("Exchange hashpartitioning(tid", 1)
    assert "HashAggregate" in above and "HashAggregate" not in below


def test_large_sides_are_hashed_not_sorted(spark, monkeypatch):
    monkeypatch.setattr(S, "is_small", lambda df: False)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        basket = S.order_basket(spark, DIR)
        plan = basket._jdf.queryExecution().executedPlan().toString()
        assert plan.count("ShuffledHashJoin") == 2 and "SortMergeJoin" not in plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_buckets_follow_the_rows(spark, monkeypatch):
    assert A._buckets(spark.range(1), 100_000_000) >= 200
    monkeypatch.setattr(A, "ROWS_PER_BUCKET", 1000)
    basket = S.order_basket(spark, DIR)
    res = A.apriori(basket, 20)
    assert res.buckets >= basket.count() // 1000
    assert res.transactions.groupBy().sum("n").first()[0] == basket.select("tid").distinct().count()


def test_kept_basket_is_not_dealt_out_again(spark, monkeypatch):
    want = sorted((r["items"], r["support"]) for r in A.apriori(S.order_basket(spark, DIR), 20).itemsets().collect())
    # repeated brands: the basket asks for more partitions than its pruned rows do
    monkeypatch.setattr(S, "ROWS_PER_PARTITION", 100)
    monkeypatch.setattr(A, "ROWS_PER_BUCKET", 100)
    plans, write = [], A.bucketed_table

    def seen(df, *args):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return write(df, *args)

    monkeypatch.setattr(A, "bucketed_table", seen)
    basket = S.order_basket(spark, DIR).persist()
    n_parts = basket.rdd.getNumPartitions()
    res = A.apriori(basket, 20)
    assert -(-sum(r["support"] for r in res.levels[0].collect()) // 100) < n_parts == res.buckets
    assert "Exchange" not in plans[0].split("InMemoryTableScan")[0]  # from the kept rows to the written table
    assert sorted((r["items"], r["support"]) for r in res.itemsets().collect()) == want
    # a basket in far more partitions than its rows need does not set the count
    assert A._buckets(basket, 100, 10_000) < 10_000 and A._buckets(basket, 100 * 100, 99) == 100
