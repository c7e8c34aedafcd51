"""Expressions over itemsets and tid lists.

Everything here returns a ``Column`` built from ``pyspark.sql.functions`` so
it stays inside whole-stage codegen."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(col: str | Column) -> Column:
    return F.col(col) if isinstance(col, str) else col


def itemset_string(items: str | Column = "items", sep: str = " ") -> Column:
    """``[1, 2, 30]`` -> ``"1 2 30"`` (array order kept)."""
    return F.array_join(F.transform(_c(items), lambda x: x.cast("string")), sep)


def prefix_of(items: str | Column = "items") -> Column:
    """All but the last element (P5, split_prefix)."""
    c = _c(items)
    return F.slice(c, 1, F.greatest(F.size(c) - 1, F.lit(0)))


def last_item(items: str | Column = "items") -> Column:
    """The last element (P5, split_prefix)."""
    return F.element_at(_c(items), -1)


def tids_intersect(a: str | Column, b: str | Column) -> Column:
    """Sorted tid list ∩ sorted tid list; order of ``a`` is kept."""
    return F.array_intersect(_c(a), _c(b))


def tids_except(a: str | Column, b: str | Column) -> Column:
    """Sorted tid list minus another; order of ``a`` is kept."""
    return F.array_except(_c(a), _c(b))


def tid_block(tid: str | Column = "tid", block_size: int = 1 << 16) -> Column:
    """Tid-range block of a transaction id.  Vertical tid lists are stored per
    (item, block) so that no single row grows with the data: a hot item that
    occurs in a third of all transactions is still split into bounded rows."""
    t = _c(tid).cast("bigint")
    return F.call_function("div", t - F.pmod(t, F.lit(block_size).cast("bigint")), F.lit(block_size).cast("bigint"))
