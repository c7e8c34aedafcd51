"""Condensed representations and result-level operators: closed (J6),
maximal (J7), the reference's forward-closed rule, union of the short and
long results (U1), length histogram (A6) and totals (A7).

All of them are joins over the itemset table (output-sized), never over the
transactions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cofreq.functions.itemsets import itemset_string
from cofreq.session import materialize


def _immediate_subsets(fis: DataFrame) -> DataFrame:
    """Every k-subset of each (k+1)-set: ``[items, support]`` of the superset."""
    subs = F.transform(
        F.sequence(F.lit(0), F.size("items") - 1),
        lambda i: F.filter("items", lambda x, j: j != i),
    )
    return fis.where(F.size("items") >= 2).select(F.explode(subs).alias("items"), "support")


def closed_only(fis: DataFrame) -> DataFrame:
    """Drop a set that has an immediate superset with equal support.
    (Equal support with any superset implies it with an immediate one.)"""
    dominated = _immediate_subsets(fis).distinct()
    return fis.join(dominated, ["items", "support"], "left_anti")


def maximal_only(fis: DataFrame) -> DataFrame:
    """Drop a set that has any frequent immediate superset."""
    covered = _immediate_subsets(fis).select("items").distinct()
    return fis.join(covered, ["items"], "left_anti")


def all_results(short: DataFrame, long: DataFrame) -> DataFrame:
    """The job's answer = short sets ∪ long sets."""
    return short.select("items", "support").unionByName(long.select("items", "support"))


def length_counts(fis: DataFrame) -> DataFrame:
    """Number of sets per length plus a ``Total`` row
    (``[level: string, cnt: bigint]``)."""
    return (
        fis.rollup(F.size("items").alias("len"))
        .agg(F.count(F.lit(1)).alias("cnt"))
        .select(F.coalesce(F.col("len").cast("string"), F.lit("Total")).alias("level"), "cnt")
    )


def itemset_total(fis: DataFrame) -> DataFrame:
    """Number of sets mined."""
    return fis.agg(F.count(F.lit(1)).alias("n_itemsets"))


def as_text(fis: DataFrame) -> DataFrame:
    """Comparable output: ``itemset`` (items ascending, blank-joined), ``support``."""
    return fis.select(itemset_string(F.array_sort("items")).alias("itemset"), F.col("support").cast("bigint"))


def extension_ranks(ext: DataFrame) -> DataFrame:
    """Position of each extension inside its prefix group, ascending
    support then item.  ``ext`` is ``[group, item, support]``; a window per
    group holds only that group's frequent extensions (output-sized)."""
    from pyspark.sql import Window

    w = Window.partitionBy("group").orderBy("support", "item")
    return ext.select("group", "item", F.row_number().over(w).alias("rank"))


def forward_closed_rule(
    members: DataFrame,
    ranks: DataFrame | None,
    group_support: DataFrame | None = None,
    break_from: int = 1,
    max_size: int | None = None,
) -> DataFrame:
    """The depth-first miner's output rule, evaluated declaratively.

    ``members`` is ``[group, rest, items, support]``: every frequent set
    ``S = group ∪ rest`` mined inside a prefix group (``rest`` non-empty).
    ``ranks`` is ``[group, item, rank]``, the fixed extension order of each
    group (None: the item value itself is the order).  Sets with an item
    outside the group's extension list are not members and are dropped.

    Writing ``r(S)`` for the sorted ranks of ``rest``, a *breaker* is a member
    ``T`` whose support equals that of ``A(T)`` = ``T`` minus its last-ranked
    item (for ``break_from == 0`` also ``A(T) = group``, compared with
    ``group_support``).  ``S`` is reported unless some breaker has
    ``r(A(T))`` equal to
      * ``r(S)`` itself (S has a later extension with equal support), unless
        ``|S|`` reached ``max_size``; or
      * a proper prefix ``r(S)[:d]`` (d >= break_from) and the breaker's last
        rank lies before ``r(S)[d]`` — the closure break that skips the later
        siblings — provided ``|T| < max_size``.
    """
    if ranks is None:
        ranked = members.select("group", "items", "support", F.array_sort("rest").alias("rs"))
    else:
        flat = members.select("group", "items", "support", F.size("rest").alias("_m"), F.explode("rest").alias("item"))
        ranked = (
            flat.join(ranks, ["group", "item"])
            .groupBy("group", "items", "support", "_m")
            .agg(F.array_sort(F.collect_list("rank")).alias("rs"))
            .where(F.size("rs") == F.col("_m"))
            .drop("_m")
        )
    # read four times below: checkpoint it (output-sized) so the plans that
    # follow start from a small leaf instead of re-deriving it
    ranked = materialize(ranked.withColumn("_len", F.size("items")))

    # breakers with A(T) inside the group (d >= 1)
    t = ranked.where(F.size("rs") >= 2).select(
        "group",
        F.slice("rs", 1, F.size("rs") - 1).alias("seg"),
        F.element_at("rs", -1).alias("ylast"),
        F.col("_len").alias("tlen"),
        F.col("support").alias("tsup"),
    )
    a = ranked.select("group", F.col("rs").alias("seg"), F.col("support").alias("asup"))
    breakers = t.join(a, ["group", "seg"]).where(F.col("tsup") == F.col("asup")).select("group", "seg", "ylast", "tlen")
    if break_from == 0:
        if group_support is None:
            raise ValueError("break_from=0 needs group_support")
        t0 = ranked.where(F.size("rs") == 1).select(
            "group", F.element_at("rs", 1).alias("ylast"), F.col("_len").alias("tlen"), F.col("support").alias("tsup")
        )
        b0 = (
            t0.join(group_support.select("group", F.col("support").alias("gsup")), "group")
            .where(F.col("tsup") == F.col("gsup"))
            .select("group", F.array().cast("array<int>").alias("seg"), "ylast", "tlen")
        )
        breakers = breakers.unionByName(b0)
    # one row for each (group, seg): the earliest breaker, and the earliest
    # among those that may still grow
    cap = F.lit(max_size if max_size is not None else 1 << 30)
    breakers = materialize(breakers.groupBy("group", "seg").agg(
        F.min(F.when(F.col("tlen") < cap, F.col("ylast"))).alias("earliest")))

    # every initial segment of every member, with the rank that follows it
    start = F.lit(break_from)
    segs = ranked.select(
        "group", "items", "support", "rs", "_len",
        F.explode(F.sequence(start, F.size("rs"))).alias("d"),
    ).select(
        "group", "items", "support", "_len",
        F.slice("rs", 1, F.col("d")).alias("seg"),
        F.when(F.col("d") < F.size("rs"), F.element_at("rs", F.col("d") + 1)).alias("nxt"),
    )
    hit = (F.col("nxt").isNull() & (F.col("_len") < cap)) | (F.col("earliest") < F.col("nxt"))
    killed = segs.join(breakers, ["group", "seg"]).where(hit).select("group", "items").distinct()
    return ranked.join(killed, ["group", "items"], "left_anti").select("group", "items", "support")
