"""J2 and J3 for a given candidate table, against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from cofreq.operators import containment as N

TX = "tid bigint, items array<int>"


def sets(df, *cols):
    return sorted((tuple(r["items"]), *(r[c] if not isinstance(r[c], list) else tuple(r[c]) for c in cols)) for r in df.collect())


@pytest.mark.parametrize("per_task", [20_000_000, 3])
def test_support_and_tids(spark, per_task, monkeypatch):
    monkeypatch.setattr(N, "PAIRS_PER_TASK", per_task)  # with 3, every key is split
    rnd = random.Random(5)
    rows = [(i, [x for x in range(9) if rnd.random() < 0.5] + [3] * (i % 3 > 0)) for i in range(60)]
    cands = [rnd.sample(range(11), rnd.randint(1, 4)) for _ in range(40)] + [[], [1, 1, 2], [2, 1], [10], [99, 3], [None, 4]]
    want = {tuple(sorted({x for x in c if x is not None})) for c in cands}
    held = {c: [t for t, items in rows if set(c) <= set(items)] for c in want}
    tx = spark.createDataFrame(rows, TX)
    table = spark.createDataFrame([(c,) for c in [*cands, None]], "items array<int>")
    long = tx.select("tid", F.explode("items").alias("item"))
    for data in (tx, long.unionAll(long)):
        here = held if data is tx else {c: [t for t in h if dict(rows)[t]] for c, h in held.items()}
        assert sets(N.count_candidates(data, table), "support") == sorted((c, len(h)) for c, h in here.items())
        got = sets(N.candidate_tid_lists(data, table, 16), "block", "tids")
        lists = []
        for c, h in here.items():
            blocks = {}
            for t in h:
                blocks.setdefault(t // 16, []).append(t)
            lists += [(c, b, tuple(ts)) for b, ts in blocks.items()] or [(c, None, ())]
        assert sorted(got, key=str) == sorted(lists, key=str)


def test_no_rows(spark):
    tx = spark.createDataFrame([(1, [1, 2])], TX)
    table = spark.createDataFrame([([1],), ([7],)], "items array<int>")
    assert sets(N.count_candidates(tx.limit(0), table), "support") == [((1,), 0), ((7,), 0)]
    assert N.count_candidates(tx, table.limit(0)).collect() == []
    assert N.candidate_tid_lists(tx, table.limit(0)).collect() == []
