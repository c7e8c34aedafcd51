"""Readers.  Every reader is a distributed scan plus built-in
expressions; only the encoded-set decoder keeps a path in Python, over the matches
of one pattern."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cofreq.sources.formats import CLOSESUP, COUNT_SEPARATOR, OPENSUP, SEPARATOR, SYMBOL

SETS_PER_FRAME = 50_000  # decoded sets handed back to Spark at once


def parse_transactions(lines: DataFrame, delimiter: str = " ", col: str = "value") -> DataFrame:
    """S1 over a DataFrame of text lines: split by the (regex) delimiter,
    drop empty tokens (blank lines are empty transactions), cast to bigint,
    keep each item once, sort ascending (O1)."""
    tokens = F.filter(F.split(F.col(col), delimiter), lambda t: F.trim(t) != F.lit(""))
    items = F.array_sort(F.array_distinct(F.transform(tokens, lambda t: F.trim(t).cast("bigint"))))
    return lines.withColumn("items", items)


def with_tid(df: DataFrame, tid: str = "tid") -> DataFrame:
    """Unique transaction ids (partition id in the high bits, row offset
    in the low bits), assigned without a shuffle."""
    return df.withColumn(tid, F.monotonically_increasing_id())


def read_transactions(spark: SparkSession, path: str, delimiter: str = " ") -> DataFrame:
    """S1 + S2: text file, one transaction per line -> ``[tid, items]``."""
    lines = spark.read.text(path)
    return with_tid(parse_transactions(lines, delimiter)).select("tid", "items")


def _int_list(col: Column, sep: str = " ") -> Column:
    return F.transform(F.filter(F.split(col, sep), lambda t: t != F.lit("")), lambda t: t.cast("bigint"))


def read_itemset_table(spark: SparkSession, path: str) -> DataFrame:
    """S3: ``items<TAB>support`` lines -> ``[items, support]``."""
    df = spark.read.csv(path, sep="\t", schema="itemset string, support bigint")
    return df.select(F.array_sort(_int_list(F.col("itemset"))).alias("items"), "support")


# one set of an encoded line: steps up, items on the way down, support
_SET = re.compile(r"(\{up}*)((?:\d+\{sep}?)*)\{open}(\d+)\{close}".format(
    up=SYMBOL, sep=SEPARATOR, open=OPENSUP, close=CLOSESUP))


def _decode_lines(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    items: list[list[int]] = []
    support: list[int] = []
    for frame in frames:
        for line in frame["value"].dropna():
            path: list[int] = []
            for up, down, count in _SET.findall(line.rpartition(COUNT_SEPARATOR)[2]):
                path = path[:max(0, len(path) - len(up))] + [int(x) for x in down.split(SEPARATOR) if x]
                items.append(sorted(path))
                support.append(int(count))
                if len(items) >= SETS_PER_FRAME:
                    yield pd.DataFrame({"items": items, "support": support})
                    items, support = [], []
    if items:
        yield pd.DataFrame({"items": items, "support": support})


def decode_itemsets(encoded: DataFrame, col: str = "value") -> DataFrame:
    """``n<TAB>encoded`` lines -> ``[items, support]``.  Each line is
    self-contained, so lines decode independently, partition by partition.
    The leading count is not validated."""
    return encoded.select(F.col(col).alias("value")).mapInPandas(
        _decode_lines, "items array<bigint>, support bigint"
    )


def read_encoded(spark: SparkSession, path: str) -> DataFrame:
    """S4 from text files."""
    return decode_itemsets(spark.read.text(path))


def read_vertical(spark: SparkSession, path: str, block_size: int = 1 << 16) -> DataFrame:
    """``item<TAB>tid tid ...`` lines (an item may span several lines)
    -> ``[item, block, support, tids]``."""
    from cofreq.operators.basket import merge_tids

    df = spark.read.csv(path, sep="\t", schema="item bigint, tids string")
    partial = df.select("item", F.transform(F.filter(F.split("tids", " "), lambda t: t != F.lit("")),
                                            lambda t: t.cast("bigint")).alias("tids"))
    merged = merge_tids(partial, ("item",), block_size)
    return merged.withColumn("support", F.size("tids").cast("bigint")).select("item", "block", "support", "tids")


def read_result(spark: SparkSession, path: str) -> DataFrame:
    """Reads what ``write_result`` wrote: ``[items, support, kind]``."""
    return spark.read.parquet(path)
