"""Connected components of a link table, by alternating large-star and
small-star rounds (every step is an aggregation or an equi-join, so a node
with very many links is neither collected nor expanded into pairs)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cofreq.llm.common import free, stage


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(
        edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where(F.col("v") > F.col("u")).join(low, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    low = down.groupBy("u").agg(F.min("v").alias("m"))
    linked = down.join(low, "u")
    return linked.where(F.col("v") != F.col("m")).select(F.col("v").alias("a"), F.col("m").alias("b")).unionAll(
        low.select(F.col("u").alias("a"), F.col("m").alias("b")))


def components(links: DataFrame) -> DataFrame:
    """``[node, label]`` for every node of ``links[a, b]``: the label is the
    smallest node of the component.  Rows with a null end or equal ends are no
    links."""
    edges = stage(links.select("a", "b").where(F.col("a") != F.col("b")).distinct(), "links")
    # a fixed point: the same edges as before
    size = lambda e: e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    before = size(edges)
    while True:
        after = stage(_small_star(_large_star(edges).distinct()).distinct(), "links")
        free(edges)
        edges, same, before = after, before == (now := size(after)), now
        if same:
            break
    nodes = edges.select(F.col("a").alias("node"), F.col("b").alias("label"))
    return nodes.unionAll(edges.select(F.col("b").alias("node"), F.col("b").alias("label"))).distinct()
