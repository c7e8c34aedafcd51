"""Column-level helpers (built-in Spark expressions only, no UDFs)."""

from cofreq.functions.itemsets import (  # noqa: F401
    itemset_string,
    last_item,
    prefix_of,
    tid_block,
    tids_except,
    tids_intersect,
)
