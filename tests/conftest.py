import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from cofreq.session import local_session

    s = local_session("*", shuffle_partitions=8)
    yield s
    s.stop()


@pytest.fixture(autouse=True)
def _release_cache(request):
    yield
    if "spark" in request.fixturenames:
        request.getfixturevalue("spark").catalog.clearCache()


def as_map(df):
    """{ 'a b c': support } with items ascending."""
    return {" ".join(map(str, sorted(r["items"]))): int(r["support"]) for r in df.collect()}


def tx_df(spark, rows):
    return spark.createDataFrame([(i, sorted(set(t))) for i, t in enumerate(rows)], "tid bigint, items array<int>")


def brute_force(rows, min_sup):
    """All frequent itemsets by definition (tiny inputs only)."""
    from itertools import combinations

    sets = [frozenset(r) for r in rows]
    items = sorted(set().union(*sets)) if sets else []
    out = {}
    k = 1
    cands = [frozenset([i]) for i in items]
    while cands:
        nxt = set()
        for c in cands:
            s = sum(1 for t in sets if c <= t)
            if s >= min_sup:
                out[" ".join(map(str, sorted(c)))] = s
                nxt.add(c)
        k += 1
        cands = {a | b for a, b in combinations(nxt, 2) if len(a | b) == k}
    return out
