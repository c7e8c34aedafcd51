"""cofreq — frequent itemset mining on Spark DataFrames.

Transactions are ``DataFrame[tid: bigint, items: array<int>]`` (or the long
form ``DataFrame[tid, item]``); results are ``DataFrame[items: array<int>,
support: bigint]``.  See the README for the operator map.
"""

from cofreq.plans.api import frequent_itemsets  # noqa: F401
