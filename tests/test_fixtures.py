"""Exact fixtures (FIXTURES.md X1-X11), with supports."""

import numpy as np
import pytest
from conftest import as_map, brute_force, tx_df
from pyspark.sql import functions as F

from cofreq.operators import basket as B
from cofreq.operators import condense as C
from cofreq.operators import levelwise as L
from cofreq.plans.apriori import apriori, first_level, next_level
from cofreq.plans.depthfirst import DepthFirst
from cofreq.plans.miners import hybrid_mine, vertical_mine

X1 = [[1, 2, 3]] * 4 + [[1, 4, 5, 6, 7], [2, 4, 5, 6, 7], [3, 4, 5, 6, 7], [4, 5, 6, 7]] + [[1, 3, 7]] * 4 + [[2, 6]] * 2


def parse(spec):
    """'13:8 123' -> {'1 3': 8, '1 2 3': 4} (default support 4)."""
    out = {}
    for tok in spec.split():
        s, _, sup = tok.partition(":")
        out[" ".join(s)] = int(sup) if sup else 4
    return out


@pytest.fixture(scope="module")
def x1(spark):
    return tx_df(spark, X1)


def test_x1_all_closed_maximal(spark, x1):
    fis = apriori(x1, 4).itemsets()
    got = as_map(fis)
    assert got == brute_force(X1, 4)
    assert len(got) == 25
    assert as_map(C.closed_only(fis)) == parse("1:9 2:7 3:9 6:6 7:8 13:8 17:5 37:5 123 137 4567")
    assert as_map(C.maximal_only(fis)) == parse("123 137 4567")
    fis3 = apriori(x1, 3).itemsets()
    assert len(as_map(fis3)) == 26 and as_map(fis3)["2 6"] == 3
    assert as_map(C.maximal_only(fis3)) == parse("26:3 123 137 4567")


def test_x1_item_rank(spark, x1):
    r = B.item_rank(B.frequent_items(B.explode_items(x1), 4)).orderBy("rank").collect()
    assert [row["item"] for row in r] == [4, 5, 6, 2, 7, 1, 3]
    assert [row["rank"] for row in r] == list(range(1, 8))


SEVEN = "1:9 2:7 3:9 4:4 5:4 6:6 7:8"


@pytest.mark.parametrize("engine", ["levelwise", "grouped"])
def test_x1_hybrid_forward_closed(spark, x1, engine):
    m1 = hybrid_mine(x1, 4, prefix_len=1, mode="forward_closed", split=True, engine=engine)
    assert as_map(m1.short) == parse(SEVEN)
    assert as_map(m1.long) == parse("13:8 17:5 37:5 23 47 57 67 123 137 467 567 4567")
    m2 = hybrid_mine(x1, 4, prefix_len=2, mode="forward_closed", split=True, engine=engine)
    assert as_map(m2.short) == {k: v for k, v in brute_force(X1, 4).items() if len(k.split()) <= 2}
    assert as_map(m2.long) == parse("123 137 457 467 567 4567")


@pytest.mark.parametrize("engine", ["levelwise", "grouped"])
def test_x1_vertical_forward_closed(spark, x1, engine):
    m = vertical_mine(x1, 4, prefix_len=2, mode="forward_closed", split=True, engine=engine)
    assert as_map(m.short) == parse(SEVEN)
    assert as_map(m.long) == parse("13:8 17:5 37:5 23 47 57 67 123 137 467 567 4567")
    m3 = vertical_mine(x1, 3, prefix_len=3, mode="forward_closed", split=True, engine=engine)
    assert as_map(m3.short) == parse(SEVEN + " 13:8 17:5 37:5 26:3 23 67")
    assert as_map(m3.long) == parse("123 137 457 567 4567")


def test_x1_condensed_chain(spark, x1):
    fis = apriori(x1, 4).itemsets()
    allm = as_map(fis)
    closed = as_map(C.closed_only(fis))
    maximal = as_map(C.maximal_only(fis))
    fc = as_map(hybrid_mine(x1, 4, prefix_len=1, mode="forward_closed"))
    assert set(maximal) <= set(closed) <= set(fc) <= set(allm)


def test_x2_walkthrough(spark):
    rows = [[1, 2], [1], [1, 2, 3], [1, 2], [1, 2], [2, 3]]
    fis = apriori(tx_df(spark, rows), 1).itemsets()
    assert as_map(fis) == {"1": 5, "2": 5, "3": 2, "1 2": 4, "1 3": 1, "2 3": 2, "1 2 3": 1}
    assert as_map(C.closed_only(fis)) == {"1": 5, "2": 5, "1 2": 4, "2 3": 2, "1 2 3": 1}
    assert as_map(C.maximal_only(fis)) == {"1 2 3": 1}


X3 = [[1, 2, 3, 4], [2, 3, 4], [1, 3, 5], [1], [3, 4, 5], [1, 3, 4, 5], [2, 5], [1, 3, 4]]


def test_x3_counts_and_tids(spark):
    tx = tx_df(spark, X3)
    basket = B.explode_items(tx)
    assert {r["item"]: r["support"] for r in B.item_supports(basket).collect()} == {1: 5, 2: 3, 3: 6, 4: 5, 5: 4}
    v = B.transpose(basket)
    assert {r["item"]: r["tids"] for r in v.collect()} == {
        1: [0, 2, 3, 5, 7], 2: [0, 1, 6], 3: [0, 1, 2, 4, 5, 7], 4: [0, 1, 4, 5, 7], 5: [2, 4, 5, 6]}
    # candidate supports / tids for the reference's candidate set
    cands = {(1, 2), (1, 3), (1, 4), (2, 3), (2, 5), (3, 4), (4, 5)}
    res = first_level(tx, 1)
    ext = L.extend_occurrences(res.occurrences[1])
    counts = {(r["sid"], r["item"]): r["support"] for r in L.count_extensions(ext).collect()}
    assert {c: counts[c] for c in cands} == {(1, 2): 1, (1, 3): 4, (1, 4): 3, (2, 3): 2, (2, 5): 1, (3, 4): 5, (4, 5): 2}
    ext = ext.select("tid", F.array(F.col("sid").cast("int")).alias("prefix"), "item")
    tids = {(r["prefix"][0], r["item"]): r["tids"] for r in L.candidate_tids(ext).collect()}
    assert {c: tids[c] for c in cands} == {(1, 2): [0], (1, 3): [0, 2, 5, 7], (1, 4): [0, 5, 7], (2, 3): [0, 1],
                                           (2, 5): [6], (3, 4): [0, 1, 4, 5, 7], (4, 5): [4, 5]}


def test_x3_empty_input(spark):
    empty = spark.createDataFrame([], "tid bigint, items array<int>")
    assert apriori(empty, 1).itemsets().count() == 0
    assert B.transpose(B.explode_items(empty)).count() == 0


def test_x4_group_stats(spark):
    level = spark.createDataFrame(
        [([], 1, 10), ([], 2, 7), ([], 3, 11), ([], 4, 1),
         ([1], 2, 10), ([1], 3, 7), ([1], 4, 11), ([1], 5, 1),
         ([2], 3, 8), ([2], 4, 9), ([2], 5, 6), ([4], 5, 10), ([4], 6, 9)],
        "prefix array<int>, item int, support bigint")
    first = level.where(F.size("prefix") == 0)
    rest = level.where(F.size("prefix") > 0)
    s = L.prefix_group_stats(first, 10).first()
    assert (s["n_groups"], s["n_large_groups"]) == (1, 1)
    assert L.prefix_group_stats(first, 50).first()["n_large_groups"] == 0
    s = L.prefix_group_stats(rest, 20).first()
    assert (s["n_groups"], s["n_large_groups"]) == (3, 2)
    assert L.prefix_group_stats(rest, 50).first()["n_large_groups"] == 0
    mc = {r["prefix"][0]: r["max_candidates"] for r in L.max_candidates(rest).collect()}
    assert mc == {1: 6, 2: 3, 4: 1}


def test_x5_merge_partial_tids(spark):
    # global tid = part * 10 + local tid
    rows = [([1], 0, 0, [1, 2, 4, 7, 9]), ([1], 1, 0, [0, 1, 2, 3, 5, 6, 8]), ([1], 0, 1, [1, 2, 3]),
            ([1], 1, 1, [4, 5, 6]), ([1], 0, 3, [4, 7, 9]), ([1], 1, 3, [4, 7, 9]),
            ([2], 0, 1, [1, 4, 7, 8]), ([2], 1, 1, [1, 5, 6, 8]), ([2], 0, 2, [3, 5, 7]),
            ([2], 1, 2, [1, 2, 3, 4, 5, 6, 7, 8, 9])]
    df = spark.createDataFrame(rows, "prefix array<int>, part int, item int, local array<bigint>")
    df = df.select("prefix", "item", F.transform("local", lambda t: t + F.col("part") * 10).alias("tids"))
    merged = B.merge_tids(df, ("prefix", "item"))
    got = {(r["prefix"][0], r["item"]): len(r["tids"]) for r in merged.collect()}
    assert got == {(1, 0): 12, (1, 1): 6, (1, 3): 6, (2, 1): 8, (2, 2): 12}


X6 = [[0, 9, 3, 5, 8], [1, 4, 2, 6, 7], [2, 4, 1, 7, 6], [3, 9, 0, 5, 8], [4, 2, 1, 7, 6], [5, 8, 0, 9, 3],
      [6, 1, 4, 2, 7], [7, 2, 4, 3, 9], [8, 5, 0, 9, 3], [9, 3, 0, 5, 8], [0, 6, 9, 4, 8], [1, 7, 3, 2, 5],
      [2, 5, 3, 1, 7], [3, 1, 7, 2, 5], [4, 5, 6, 0, 2], [5, 4, 2, 3, 1], [6, 0, 9, 4, 8], [7, 1, 3, 2, 5],
      [8, 9, 0, 6, 4], [9, 8, 0, 6, 4]]


def test_x6_group_sets_and_rule(spark):
    """One group's sets, depth first: all of them followed by the output rule
    with the caller's extension order, and those that the search itself reports."""
    def mined(prefix, order, min_sup, max_len=None):
        base = [set(t) for t in X6 if set(prefix) <= set(t)]
        lists = [np.array([i for i, t in enumerate(base) if x in t], np.int64) for x in order]
        room = 99 if max_len is None else max_len - len(prefix)
        found = list(DepthFirst(order, lists, min_sup, room).sets())
        rows = [(list(prefix), rest, sorted([*prefix, *rest]), n) for rest, n in found]
        members = spark.createDataFrame(rows, "group array<int>, rest array<int>, items array<int>, support bigint")
        ranks = spark.createDataFrame([(list(prefix), x, i) for i, x in enumerate(order)], "group array<int>, item int, rank int")
        by_rule = as_map(C.forward_closed_rule(members, ranks, max_size=max_len))
        own = {" ".join(map(str, sorted([*prefix, *rest]))): n for rest, n in DepthFirst(order, lists, min_sup, room, True).sets()}
        assert own == by_rule
        return own

    assert mined([1], [2, 7], 6) == {"1 2": 9, "1 7": 8, "1 2 7": 8}
    assert mined([1], [2, 3, 5], 5) == {"1 2": 9, "1 5": 5, "1 2 5": 5, "1 3 5": 5, "1 2 3 5": 5}
    assert mined([5], [8, 9], 5) == {"5 9": 5, "5 8 9": 5}
    assert mined([5, 8], [9, 0], 5) == {"0 5 8": 5, "0 5 8 9": 5}
    assert mined([1], [2, 3, 5], 5, max_len=2) == {"1 2": 9, "1 3": 5, "1 5": 5}


def test_x6_rule_with_given_order(spark):
    """The declarative rule, fed the same caller-supplied order."""
    fis = apriori(tx_df(spark, X6), 5).itemsets()
    members = fis.where(F.array_contains("items", 1) & (F.size("items") >= 2)).where(
        F.forall(F.array_remove("items", 1), lambda x: x.isin(2, 3, 5)))
    members = members.select(F.array(F.lit(1)).alias("group"), F.array_remove("items", 1).alias("rest"), "items", "support")
    ranks = spark.createDataFrame([([1], 2, 1), ([1], 3, 2), ([1], 5, 3)], "group array<int>, item int, rank int")
    got = as_map(C.forward_closed_rule(members, ranks))
    assert got == {"1 2": 9, "1 5": 5, "1 2 5": 5, "1 3 5": 5, "1 2 3 5": 5}
    got2 = as_map(C.forward_closed_rule(members.where(F.size("items") <= 2), ranks, max_size=2))
    assert got2 == {"1 2": 9, "1 3": 5, "1 5": 5}


def test_x7_tid_algebra(spark):
    from cofreq.functions.itemsets import tids_except, tids_intersect

    df = spark.createDataFrame([([], [1, 2, 3, 4, 5]), ([1, 2, 3, 4, 5], []), ([6, 7, 8], [1, 2, 3]),
                                ([1, 2, 3, 4, 5], [1, 3, 5, 7, 9])], "a array<bigint>, b array<bigint>")
    got = [(r["i"], r["d"]) for r in df.select(tids_intersect("a", "b").alias("i"), tids_except("a", "b").alias("d")).collect()]
    assert got == [([], []), ([], [1, 2, 3, 4, 5]), ([], [6, 7, 8]), ([1, 3, 5], [2, 4])]


def test_x8_transpose_with_duplicates(spark, tmp_path):
    from cofreq.sources.readers import read_transactions

    p = tmp_path / "dup.txt"
    p.write_text("1 2 3 4 1\n4 1 4 5 7\n3 5 5 6\n4 7 4\n")
    tx = read_transactions(spark, str(p))
    # tids from with_tid are unique but not dense; renumber by line order
    order = {r["tid"]: i for i, r in enumerate(tx.orderBy("tid").collect())}
    v = B.transpose(B.explode_items(tx)).collect()
    got = {r["item"]: sorted(order[t] for t in r["tids"]) for r in v}
    assert got == {1: [0, 1], 2: [0], 3: [0, 2], 4: [0, 1, 3], 5: [1, 2], 6: [2], 7: [1, 3]}


X9 = [("1\t1|2|30(12)", {"1 2 30": 12}),
      ("2\t1|2|30(12)8|9|19(10)", {"1 2 30": 12, "1 2 8 9 19 30": 10}),
      ("1\t1|2|30(12)8|9(10)$5(11)", {"1 2 30": 12, "1 2 8 9 30": 10, "1 2 5 8 30": 11}),
      ("3\t1|3(1)2(1)$$2(4)", {"1 3": 1, "1 2 3": 1, "1 2": 4})]


@pytest.mark.parametrize("line,expected", X9)
def test_x9_decode(spark, line, expected):
    from cofreq.sources.readers import decode_itemsets

    df = spark.createDataFrame([(line,)], "value string")
    got = {" ".join(map(str, sorted(r["items"], key=int))): r["support"] for r in decode_itemsets(df).collect()}
    assert got == {" ".join(sorted(k.split(), key=int)): v for k, v in expected.items()}


def test_x10_parse_and_restrict(spark):
    from cofreq.sources.readers import parse_transactions

    lines = spark.createDataFrame([("1 5 6",), ("4 6 7",), ("2 5 6",), ("",), ("3  3 1",)], "value string")
    tx = parse_transactions(lines)
    assert [r["items"] for r in tx.collect()] == [[1, 5, 6], [4, 6, 7], [2, 5, 6], [], [1, 3]]
    r = B.restrict_items(tx.limit(3), [4, 6, 7]).collect()
    assert [x["items"] for x in r] == [[6], [4, 6, 7], [6]]


def test_x11_line_counts(spark, tmp_path):
    from cofreq.sources.readers import read_transactions

    (tmp_path / "e.txt").write_text("")
    (tmp_path / "t.txt").write_text("12345\n678910\n1510\n")
    assert B.transaction_count(read_transactions(spark, str(tmp_path / "e.txt"))).first()[0] == 0
    assert B.transaction_count(read_transactions(spark, str(tmp_path / "t.txt"))).first()[0] == 3


def test_x3_diffsets(spark):
    """J5 from tid lists and one level deeper from diffsets (prefix {3})."""
    from cofreq.operators import vertical as V

    tx = tx_df(spark, X3)
    v = B.transpose(B.explode_items(tx))
    pairs = spark.createDataFrame([(1, 3), (3, 4), (2, 5)], "a int, b int")
    got = {(r["a"], r["b"]): (r["support"], r["diff_size"]) for r in V.diffset_support(pairs, v).collect()}
    assert got == {(1, 3): (4, 1), (3, 4): (5, 1), (2, 5): (1, 2)}
    # diffsets relative to P = {3}: d(x) = t(3) minus t(3x)
    group = spark.createDataFrame(
        [([3], 1, 4, 0, [1, 4]), ([3], 4, 5, 0, [2]), ([3], 5, 3, 0, [0, 1, 7])],
        "prefix array<int>, item int, support bigint, block bigint, diff array<bigint>")
    sib = spark.createDataFrame([([3], 1, 4), ([3], 4, 5), ([3], 1, 5)], "prefix array<int>, a int, b int")
    ext = {(r["a"], r["b"]): r["support"] for r in V.diffset_extend(group, sib).collect()}
    assert ext == {(1, 4): 3, (4, 5): 2, (1, 5): 2}
    inter = V.intersect_tids(spark.createDataFrame([([1, 3, 4],)], "items array<int>"), v).collect()
    assert [r["tids"] for r in inter] == [[0, 5, 7]]


def test_x1_generate_candidates_occurring(spark, x1):
    """J1 (re-aimed): pairs of frequent k-sets sharing their first k-1 items,
    kept when the joined set occurs in some transaction."""
    from itertools import combinations

    res = first_level(x1, 4)
    next_level(res)
    cands = L.generate_candidates(res.occurrence_items(2), res.basket, res.levels[1])
    got = {tuple(r["prefix"]) + (r["item"],) for r in cands.collect()}
    freq2 = {tuple(map(int, k.split())) for k, v in brute_force(X1, 4).items() if len(k.split()) == 2}
    joined = {(a[0], a[1], b[1]) for a in freq2 for b in freq2 if a[0] == b[0] and a[1] < b[1]}
    occurring = {c for c in joined if any(set(c) <= set(t) for t in X1)}
    assert got == occurring
    assert all(c in joined for c in got)
    assert {c for c in combinations(range(1, 8), 3)} >= got
