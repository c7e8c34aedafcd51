"""K1-K7: sinks.  Encoders are window + aggregate plans: every output line
holds a bounded number of sets and is self-contained."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cofreq.functions.itemsets import itemset_string, prefix_of
from cofreq.sources.formats import CLOSESUP, COUNT_SEPARATOR, OPENSUP, SEPARATOR, SYMBOL

MAX_SETS_PER_LINE = 100_000
SHORT_LINE_SPAN = 1_000  # item ids that one line of short sets may cover


def _piece(previous: str, items: str, support: str):
    """What the format writes for a set after ``previous`` (null: first of a
    line): steps up to the common prefix, the new items, the support."""
    prev = F.coalesce(F.col(previous), F.slice(items, 1, 0))
    same = F.zip_with(items, prev, lambda a, b: F.coalesce(a == b, F.lit(False)))
    differs = F.array_position(same, F.lit(False)).cast("int")
    common = F.when(differs > 0, differs - 1).otherwise(F.size(same))
    added = F.slice(items, common + 1, F.size(items))
    return F.concat(F.repeat(F.lit(SYMBOL), F.size(prev) - common), itemset_string(added, SEPARATOR),
                    F.lit(OPENSUP), F.col(support).cast("string"), F.lit(CLOSESUP))


def encode_itemsets(fis: DataFrame, max_sets: int = MAX_SETS_PER_LINE) -> DataFrame:
    """K1: sets in depth-first (lexicographic) order -> ``[n, encoded]`` lines.

    The sets are range-partitioned by their item arrays (a distributed sort: a
    hot leading item is split by the sampled bounds); inside a range they are
    numbered and cut into lines of at most ``max_sets`` sets.  Every line starts
    from the empty set, so lines decode independently."""
    sets = fis.select(F.array_sort("items").alias("items"), F.col("support").cast("bigint").alias("support"))
    # no fixed partition count: AQE sizes (coalesces) the range partitions
    ranged = sets.repartitionByRange("items").withColumn("part", F.spark_partition_id())
    numbered = ranged.withColumn("nth", F.row_number().over(Window.partitionBy("part").orderBy("items", "support")) - 1)
    line = numbered.withColumn("line", F.floor(F.col("nth") / F.lit(max_sets)))
    w = Window.partitionBy("part", "line").orderBy("nth")
    pieces = line.withColumn("prev", F.lag("items").over(w)).select(
        "part", "line", F.struct("nth", _piece("prev", "items", "support").alias("text")).alias("piece"))
    return pieces.groupBy("part", "line").agg(  # at most max_sets pieces
        F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list("piece")).alias("pieces")).select(
        "n", F.array_join(F.transform("pieces", lambda p: p["text"]), "").alias("encoded"))


def encoded_total(enc: DataFrame) -> DataFrame:
    """A7 on encoded rows: the number of sets is the sum of the line counts."""
    return enc.agg(F.sum("n").cast("bigint").alias("n_itemsets"))


def encoded_lines(enc: DataFrame) -> DataFrame:
    """``[n, encoded]`` -> text lines ``n<TAB>encoded``."""
    return enc.select(F.concat(F.col("n").cast("string"), F.lit(COUNT_SEPARATOR), "encoded").alias("value"))


def encode_short_itemsets(levels: DataFrame, span: int = SHORT_LINE_SPAN) -> DataFrame:
    """K2: lines ``p1|p2|x(s)$y(s)`` with their extension count.  ``levels`` is
    ``[prefix, item, support]`` of any lengths; the extensions of a prefix are
    cut into lines by item range, so a line holds at most ``span`` of them."""
    part = F.call_function("div", F.col("item").cast("bigint"), F.lit(span).cast("bigint"))
    entry = F.struct("item", F.concat(F.col("item").cast("string"), F.lit(OPENSUP),
                                      F.col("support").cast("string"), F.lit(CLOSESUP)).alias("txt"))
    g = levels.groupBy("prefix", part.alias("part")).agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(entry)).alias("_e"))
    body = F.array_join(F.transform("_e", lambda x: x["txt"]), SYMBOL)
    head = F.when(F.size("prefix") > 0, F.concat(itemset_string("prefix", SEPARATOR), F.lit(SEPARATOR))).otherwise(F.lit(""))
    return g.select("n", F.concat(head, body).alias("encoded"))


def itemset_lines(fis: DataFrame) -> DataFrame:
    """K3: ``1 2 3 (12)``."""
    return fis.select(
        F.concat(itemset_string(F.array_sort("items")), F.lit(" " + OPENSUP), F.col("support").cast("string"),
                 F.lit(CLOSESUP)).alias("value")
    )


def write_itemsets_text(fis: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """K3 to text files."""
    itemset_lines(fis).write.mode(mode).text(path)


def write_itemset_table(fis: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """K4: ``items<TAB>support``."""
    fis.select(itemset_string(F.array_sort("items")).alias("itemset"), "support").write.mode(mode).csv(path, sep="\t")


def write_encoded(fis: DataFrame, path: str, mode: str = "errorifexists", max_sets: int = MAX_SETS_PER_LINE) -> None:
    """K1 to text files."""
    encoded_lines(encode_itemsets(fis, max_sets)).write.mode(mode).text(path)


def vertical_lines(vertical: DataFrame) -> DataFrame:
    """K5: ``item<TAB>tid tid ...``, one line per (item, tid block)."""
    return vertical.select(
        F.concat(F.col("item").cast("string"), F.lit("\t"), itemset_string(F.array_sort("tids"))).alias("value"),
        "item", "block",
    )


def write_vertical(vertical: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """K5 to text files, items ascending (range-partitioned, not one task)."""
    lines = vertical_lines(vertical)
    lines.repartitionByRange("item", "block").sortWithinPartitions("item", "block").select("value").write.mode(
        mode).text(path)


def write_result(short: DataFrame, long: DataFrame, path: str, mode: str = "overwrite") -> None:
    """K6/K7: the short and the long result as one Parquet table partitioned
    by ``kind`` (``short``/``long``); ``mode`` as in DataFrameWriter."""
    out = short.select("items", "support", F.lit("short").alias("kind")).unionByName(
        long.select("items", "support", F.lit("long").alias("kind"))
    )
    out.write.mode(mode).partitionBy("kind").parquet(path)


def split_prefix(fis: DataFrame) -> DataFrame:
    """P5 as a table transform."""
    return fis.select(prefix_of("items").alias("prefix"), F.element_at("items", -1).alias("item"), "support")
