"""Operator 8: sharding by vector bin packing.

Every document is a vector (bytes, tokens, rows).  Documents with equal texts
form a group that stays together; a group that is too heavy for one slice
(``1/slices`` of a shard in any dimension) is split by a hash of its ids, so a
hot text never unbalances a shard.  All other groups are gathered by hash into
a fixed number of slices.  The number of items (slices and parts of heavy
groups) is therefore bounded by constants, whatever the corpus: they are
placed on the driver, largest first, each into the shard where the dot product
of its vector with the residual capacity is highest; a last pass moves items
from the largest to the smallest shard while that narrows the byte gap.

Defined results: null text counts 8 bytes, no tokens, and forms one group of
its own; repeated rows are placed as rows of the same group and each gets its
own slot; null ids are allowed; an empty table gives an empty result; other
columns are ignored."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cofreq.llm.common import bytes_len, stage

ROW_OVERHEAD = 8  # bytes counted for each row besides its text
SLICES = 256  # items per shard, roughly
SLOT_BLOCK = 50_000  # rows numbered together


def place(vectors: np.ndarray, n_shards: int) -> np.ndarray:
    """Shard of each item (rows of ``vectors``): highest dot product with the
    residual capacity, largest item first, then byte-gap repair."""
    n = len(vectors)
    if n == 0:
        return np.zeros(0, np.int64)
    v = vectors / np.maximum(vectors.sum(axis=0), 1) * n_shards  # a shard's capacity is 1 in each dimension
    residual = np.ones((n_shards, v.shape[1]))
    out = np.zeros(n, np.int64)
    for i in np.lexsort((np.arange(n), -v.max(axis=1))):
        s = int(np.argmax(residual @ v[i]))
        out[i] = s
        residual[s] -= v[i]
    size = vectors[:, 0].astype(np.int64)
    load = np.bincount(out, size, n_shards).astype(np.int64)
    for _ in range(40 * n_shards):
        hi, lo = int(load.argmax()), int(load.argmin())
        gap = load[hi] - load[lo]
        mine = np.flatnonzero((out == hi) & (size > 0) & (size < gap))
        if not len(mine):
            break
        i = mine[np.argmin(np.abs(size[mine] - gap / 2))]
        out[i] = lo
        load[hi] -= size[i]
        load[lo] += size[i]
    return out


def vector_shards(df: DataFrame, n_shards: int = 24, id_col: str = "doc_id", text_col: str = "text",
                  slices: int = SLICES) -> DataFrame:
    """``[doc_id, size, text_crc32, shard, slot]`` for every row."""
    text = F.col(text_col)
    base = stage(df.select(
        F.col(id_col).alias("doc_id"),
        (bytes_len(text_col) + F.lit(ROW_OVERHEAD)).alias("size"),
        F.coalesce(F.crc32(text), F.lit(0)).cast("bigint").alias("text_crc32"),
        # a word starts at each blank; exact tokenisation is not needed to balance
        F.coalesce(F.length(text) - F.length(F.translate(text, " \n\t", "")) + 1, F.lit(0)).cast("bigint")
        .alias("tokens"),
        F.coalesce(F.unhex(F.md5(text)), F.lit(b"")).alias("grp"),
    ), "shards")
    n_slices = n_shards * slices
    tot = base.agg(F.sum("size").alias("b"), F.sum("tokens").alias("t"), F.count(F.lit(1)).alias("r")).first()
    n_rows = int(tot["r"])
    if n_rows == 0:
        return base.select("doc_id", "size", "text_crc32", F.lit(0).alias("shard"), F.lit(0).cast("bigint").alias("slot"))
    cap = [max(1.0, (tot[c] or 0) / n_slices) for c in ("b", "t", "r")]
    sums = [F.sum("size").alias("b"), F.sum("tokens").alias("t"), F.count(F.lit(1)).alias("r")]
    parts = F.ceil(F.greatest(F.col("b") / cap[0], F.col("t") / cap[1], F.col("r") / cap[2])).cast("int")
    # at most 3 * n_slices groups can exceed a slice: a proven bound
    heavy = base.groupBy("grp").agg(*sums).where((parts > 1) & (F.col("r") > 1)).select("grp", parts.alias("parts"))
    item = F.when(
        F.col("parts").isNull(), F.pmod(F.xxhash64("grp"), F.lit(n_slices))
    ).otherwise(F.lit(n_slices) + F.pmod(F.xxhash64("grp"), F.lit(1 << 40)) * F.lit(1 << 16)
                + F.pmod(F.xxhash64("doc_id"), F.col("parts")))
    items = base.join(F.broadcast(heavy), "grp", "left").withColumn("item", item)
    stats = items.groupBy("item").agg(*sums).orderBy("item").collect()  # at most 7 * n_slices rows
    where = place(np.array([[s["b"], s["t"], s["r"]] for s in stats], float).reshape(-1, 3), n_shards)
    spark = df.sparkSession
    placed = spark.createDataFrame([(int(s["item"]), int(w)) for s, w in zip(stats, where)], "item bigint, shard int")
    n_blocks = max(1, n_rows // (n_shards * SLOT_BLOCK))
    rows = items.join(F.broadcast(placed), "item").select(
        "doc_id", "size", "text_crc32", "shard", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(n_blocks)).alias("block")
    )
    counts = rows.groupBy("shard", "block").agg(F.count(F.lit(1)).alias("n"))
    before = counts.select("shard", "block", (
        F.sum("n").over(Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, 0))
        - F.col("n")).alias("base"))
    number = F.row_number().over(Window.partitionBy("shard", "block").orderBy("doc_id", "text_crc32", "size"))
    return rows.withColumn("nth", number).join(before, ["shard", "block"]).select(
        "doc_id", "size", "text_crc32", "shard", (F.col("base") + F.col("nth") - 1).cast("bigint").alias("slot")
    )
