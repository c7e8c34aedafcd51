"""F8: one entry point over the miners."""

from __future__ import annotations

from pyspark.sql import DataFrame


def frequent_itemsets(
    data: DataFrame,
    min_sup: int,
    mode: str = "all",
    method: str = "hybrid",
    prefix_len: int = 1,
    min_len: int = 1,
    max_len: int | None = None,
    **kwargs,
) -> DataFrame:
    """Mine ``data`` (``[tid, items]`` or ``[tid, item]``) at absolute support
    ``min_sup``.

    mode: ``all`` | ``closed`` | ``maximal`` | ``forward_closed``
    method: ``hybrid`` (level-wise then per-prefix-group), ``vertical``
    (tid-list seeds then per-prefix-group) or ``apriori`` (level-wise only).
    Returns ``[items, support: bigint]`` (items of the input's item type), items ascending."""
    from pyspark.sql import functions as F

    from cofreq.operators.condense import closed_only, maximal_only
    from cofreq.plans.apriori import apriori
    from cofreq.plans.miners import check, hybrid_mine, vertical_mine

    check(min_sup, mode, ("all", "closed", "maximal", "forward_closed"))
    if method not in ("hybrid", "vertical", "apriori"):
        raise ValueError(f"unknown method {method!r}")
    if method == "apriori" and (kwargs or mode == "forward_closed"):
        raise ValueError("method 'apriori' has no prefix groups: no further options and no forward_closed")
    if prefix_len < 1 or min_len < 1 or (max_len is not None and max_len < 1):
        raise ValueError("prefix_len, min_len and max_len must be at least 1")

    if mode in ("all", "closed", "maximal"):
        # closedness/maximality need the immediate supersets: mine one more level
        extra = 0 if (mode == "all" or max_len is None) else 1
        limit = None if max_len is None else max_len + extra
        if method == "apriori":
            fis = apriori(data, min_sup, limit).itemsets()
        elif method == "vertical":
            fis = vertical_mine(data, min_sup, prefix_len=max(prefix_len, 2), mode="all", max_len=limit, **kwargs)
        else:
            fis = hybrid_mine(data, min_sup, prefix_len=prefix_len, mode="all", max_len=limit, **kwargs)
        if mode == "closed":
            fis = closed_only(fis)
        elif mode == "maximal":
            fis = maximal_only(fis)
    else:
        mine = vertical_mine if method == "vertical" else hybrid_mine
        fis = mine(data, min_sup, prefix_len=prefix_len, mode=mode, max_len=max_len, **kwargs)
    if max_len is not None:
        fis = fis.where(F.size("items") <= F.lit(max_len))
    if min_len > 1:
        fis = fis.where(F.size("items") >= F.lit(min_len))
    return fis
