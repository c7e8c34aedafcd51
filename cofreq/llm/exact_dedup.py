"""Operator 12: exact duplicates by a tree merge of sorted digest runs.

1. *Leaves.*  Every partition of the table becomes a run: digest entries of its
   rows in digest order, written once.  An entry is keyed by the SHA-256 of the
   normalised text (A-Z lower-cased, null as empty), verified by its length in
   bytes and an independent 64-bit hash: entries are one text only if all three
   agree, at every level of the tree.
2. *Rounds.*  Runs are numbered; in round j the runs whose numbers agree but for
   the bits ``FAN_BITS j ... FAN_BITS (j + 1) - 1`` are merged, ``2 ** FAN_BITS``
   at a time, keeping of each text the identifier that stays and the number of
   rows.  Entries move by (digest, run), so the runs that hold one very common
   text are merged by different tasks until few are left; after the leaves a
   text is one entry a run, whatever its number of copies.
3. *Verdicts.*  Entries of more than one row go back to the rows.  Texts of more
   than ``n / HEAVY`` rows, of which there are fewer than ``HEAVY``, are
   broadcast, so that their copies do not meet in one task; the rest are joined
   by digest.

Only DataFrame functions are used.  Defined results: null is an empty text;
empty texts are equal; of rows with equal text and id (repeated rows) exactly
one stays; a row with a null id stays only if its text has no row with an id;
an empty table gives no rows; other columns are ignored, whatever their names."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cofreq.llm.common import stage

FAN_BITS = 3  # eight runs are merged at a time
HEAVY = 20_000  # bound on the number of broadcast entries
LIGHT_ROWS = 1_000  # texts of at most this many rows are never broadcast
_KEY = ("digest", "n_bytes", "check")


def normalised(text: Column) -> Column:
    """Null as empty, A-Z in lower case, everything else as it is."""
    return F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)


def leaf_runs(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``[doc_id, row, run, digest, n_bytes, check]`` for every row, written: a
    sorted run for each partition; ``row`` tells repeated rows apart."""
    norm = df.select(F.col(id_col).alias("doc_id"), normalised(F.col(text_col)).alias("norm"))
    entries = norm.select("doc_id", F.unhex(F.sha2(F.col("norm").cast("binary"), 256)).alias("digest"),
                          F.octet_length("norm").alias("n_bytes"), F.xxhash64("norm").alias("check"),
                          F.monotonically_increasing_id().alias("row"), F.spark_partition_id().alias("run"))
    return stage(entries.sortWithinPartitions("digest"), "leaf-runs")


def merge_runs(leaves: DataFrame, keep: str = "smallest") -> DataFrame:
    """``[digest, n_bytes, check, keep_id, keep_row, group_size]``: the run at
    the root of the tree, one entry for each distinct text."""
    if keep not in ("smallest", "largest"):
        raise ValueError("keep is 'smallest' or 'largest'")
    named = F.col("doc_id").isNotNull()
    if keep == "smallest":
        best, entry = F.min, F.struct((~named).alias("nameless"), "doc_id", "row")
    else:
        best, entry = F.max, F.struct(named.alias("named"), "doc_id", "row")
    runs = leaves.select(*_KEY, "run", entry.alias("entry"), F.lit(1).cast("bigint").alias("n"))
    left = leaves.agg(F.max("run")).first()[0] or 0  # the largest run number
    at_leaf = True
    while at_leaf or left > 0:
        shift = 0 if at_leaf else FAN_BITS
        runs = runs.withColumn("run", F.shiftright("run", shift)).groupBy(*_KEY, "run").agg(
            best("entry").alias("entry"), F.sum("n").alias("n"))
        left, at_leaf = left >> shift, False
    return runs.select(*_KEY, F.col("entry.doc_id").alias("keep_id"), F.col("entry.row").alias("keep_row"),
                       F.col("n").alias("group_size"))


def exact_duplicates(df: DataFrame, keep: str = "smallest", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``[doc_id, keep_id, group_size, kept, text_sha256]`` for every row."""
    leaves = leaf_runs(df, id_col, text_col)
    n_rows = leaves.count()
    shared = stage(merge_runs(leaves, keep).where(F.col("group_size") > 1), "merged-runs")
    bound = max(LIGHT_ROWS, n_rows // HEAVY)
    heavy, light = shared.where(F.col("group_size") > bound), shared.where(F.col("group_size") <= bound)
    tried = leaves.join(F.broadcast(heavy), list(_KEY), "left")
    hot = tried.where(F.col("group_size").isNotNull())
    rest = leaves.join(F.broadcast(heavy.select(*_KEY)), list(_KEY), "left_anti").join(light, list(_KEY), "left")
    alone = F.col("group_size").isNull()
    return hot.unionByName(rest).select(
        "doc_id", F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("bigint")).alias("group_size"),
        (alone | (F.col("row") == F.col("keep_row"))).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))
