"""The test basket built from the TPC-H-style tables.

One transaction per order; its items are
  * the brand number of each line's part (1-25),
  * 100 + the customer's nation key,
  * 200 + the nation's region key,
  * 300 + the first digit of the order priority.
NULL items are dropped and every (tid, item) pair is kept once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cofreq.session import is_small

ROWS_PER_PARTITION = 500_000  # (tid, item) rows that one task holds

# Fixed offsets that keep the four item families apart.
NATION_OFFSET = 100
REGION_OFFSET = 200
PRIORITY_OFFSET = 300


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession, n_rows: int) -> int:
    return max(spark.sparkContext.defaultParallelism, -(-n_rows // ROWS_PER_PARTITION))


def _side(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if is_small(df) else df.hint("shuffle_hash")


def order_basket(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long form ``DataFrame[tid: bigint, item: int]`` (distinct pairs), hash
    partitioned by ``tid``.

    The rows are dealt out by ``tid`` once, before anything is held for them, to
    as many partitions as there are rows for: the distinct pairs and all that is
    grouped by ``tid`` later need no further exchange, and no task's hash table
    grows with the input.  The sides of the joins are broadcast if counted small;
    beyond that they are hashed, so that the lines and orders are not sorted."""
    lineitem = _read(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    part = _read(spark, sf_dir, "part").select("p_partkey", "p_brand")
    orders = _read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    n_parts = partitions(spark, lineitem.count() + 3 * orders.count())
    customer = _read(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    nation = _read(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")

    brand = part.select("p_partkey", F.regexp_extract("p_brand", r"(\d+)$", 1).try_cast("int").alias("item"))
    brands = lineitem.join(_side(brand), lineitem.l_partkey == brand.p_partkey).select(
        F.col("l_orderkey").alias("tid"), "item"
    )
    # nation has 25 rows: a broadcast of a fixed-size dimension.
    geo = (
        orders.join(_side(customer), orders.o_custkey == customer.c_custkey)
        .join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey"), "left")
        .select(
            F.col("o_orderkey").alias("tid"),
            F.array(
                F.col("c_nationkey") + F.lit(NATION_OFFSET),
                F.col("n_regionkey") + F.lit(REGION_OFFSET),
                F.substring("o_orderpriority", 1, 1).try_cast("int") + F.lit(PRIORITY_OFFSET),
            ).alias("its"),
        )
        .select("tid", F.explode("its").alias("item"))
    )
    return (
        brands.unionByName(geo)
        .where(F.col("item").isNotNull())
        .select(F.col("tid").cast("bigint"), F.col("item").cast("int"))
        .repartition(n_parts, "tid")
        .distinct()
    )


def order_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested form ``DataFrame[tid: bigint, items: array<int>]``."""
    from cofreq.operators.basket import baskets

    return baskets(order_basket(spark, sf_dir), "tid", "item")


# The same basket as DuckDB SQL, used by the oracle queries.
BASKET_SQL = f"""
basket AS (
  SELECT DISTINCT tid, item FROM (
    SELECT l.l_orderkey AS tid,
           TRY_CAST(regexp_extract(p.p_brand, '(\\d+)$', 1) AS INTEGER) AS item
      FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey
    UNION ALL
    SELECT o.o_orderkey, c.c_nationkey + {NATION_OFFSET}
      FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
    UNION ALL
    SELECT o.o_orderkey, n.n_regionkey + {REGION_OFFSET}
      FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
      LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey
    UNION ALL
    SELECT o.o_orderkey, TRY_CAST(substr(o.o_orderpriority, 1, 1) AS INTEGER) + {PRIORITY_OFFSET}
      FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
  ) WHERE item IS NOT NULL
)"""
