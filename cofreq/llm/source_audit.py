"""Operator 13: divergence of the sources of each language.

1. *Tokens.*  One ``bytes.translate`` lowers A-Z and blanks all other ASCII that
   is no letter, ``bytes.split`` gives the terms and a ``Counter`` their
   frequencies in the document.  Tasks add up the counters of their documents
   and hand back sparse sums ``(lang, source, term, occurrences, documents)``
   whenever they hold ``HELD`` entries.
2. *Vocabulary.*  Sparse sums by (lang, term) give the terms that at least
   ``min_docs`` documents of the language hold, their number V, and smoothed
   shares in parts of a thousand million, in exact integers.
3. *Pairs.*  The terms of a language are dealt into chunks of about
   ``CHUNK_TERMS`` and its sources into blocks of ``BLOCK_SOURCES``; a task holds
   one chunk for two blocks as a dense matrix, so its size is bounded by these
   constants, and adds up the divergence of every pair of their sources.  Terms
   that neither block holds contribute one value, known from V.
4. *Terms.*  The terms that a source uses more than its language, ranked; only
   the leading ones of each task are shuffled.

Defined results: null text, lang and source are ''; a row without terms still
makes its (lang, source) group; repeated rows are documents of their own; an
empty table gives no rows; other columns are ignored, whatever their names."""

from __future__ import annotations

import string
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cofreq.llm.common import batch_sizes, stage, utf8
from cofreq.session import ship_package

SCALE = 1_000_000_000
HELD = 500_000  # entries that a task holds before it hands them back
ONE_DOC = 1 << 40  # an entry counts occurrences below, documents above this
CHUNK_TERMS = 4_096
BLOCK_SOURCES = 256

_LOWER = bytes(b + 32 if chr(b) in string.ascii_uppercase else b if chr(b) in string.ascii_lowercase or b >= 0x80 else 0x20
               for b in range(256))


def term_counts(text: bytes) -> Counter:
    """The terms of one document and how often it holds each."""
    return Counter(text.translate(_LOWER).split())


def sparse_counts(df: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """``[lang, source, term, n, docs]``: occurrences and documents of each term,
    summed over the table; a null term counts the documents of the group."""
    def rows(held: dict[tuple, dict]) -> pa.RecordBatch:
        flat = [(lang, source, term, both) for (lang, source), terms in held.items() for term, both in terms.items()]
        lang, source, term, both = zip(*flat)
        both = np.array(both, np.int64)
        return pa.RecordBatch.from_arrays(
            [pa.array(x, pa.binary()).cast(pa.string()) for x in (lang, source, term)]
            + [pa.array(both % ONE_DOC), pa.array(both // ONE_DOC)], names=["lang", "source", "term", "n", "docs"])

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, seen = {}, 0, 0
        for batch in batches:
            for lang, source, text in zip(*(utf8(batch, c) for c in ("lang", "source", "text"))):
                terms = held.setdefault((lang, source), {None: 0})
                before = len(terms)
                terms[None] += ONE_DOC
                get = terms.get
                for term, n in term_counts(text).items():
                    terms[term] = get(term, 0) + n + ONE_DOC
                size += len(terms) - before + 1
                seen += len(text)
                if size >= HELD or seen >= ONE_DOC // 2:
                    yield rows(held)
                    held, size, seen = {}, 0, 0
        if held:
            yield rows(held)

    ship_package(df.sparkSession)
    batch_sizes(df.sparkSession)
    text = df.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(a) for c, a in (
        (lang_col, "lang"), (source_col, "source"), (text_col, "text"))))
    found = text.mapInArrow(count, "lang string, source string, term string, n bigint, docs bigint")
    return found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _share(n: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SCALE * (n + 1) / (total + terms)), exactly."""
    wide = F.call_function("div", F.lit(SCALE).cast("decimal(10,0)") * (n + 1).cast("decimal(20,0)"), (total + terms).cast("decimal(20,0)"))
    # products that 64 bits hold need no decimals
    return F.lit(1).cast("bigint") + F.when(n < 9 * SCALE, F.call_function("div", F.lit(SCALE).cast("bigint") * (n + 1), total + terms)
                                            ).otherwise(wide)


def _divergence(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def pair_sums(frame: pd.DataFrame) -> pd.DataFrame:
    """Divergences of the pairs of sources of two blocks over the terms of one
    chunk that they hold.  Rows without a term name a source and its share of a
    term that it does not hold."""
    own = frame[frame["term"].isna()].sort_values("idx")
    idx, block = own["idx"].to_numpy(), own["block"].to_numpy()
    held = frame[frame["term"].notna()]
    codes, names = pd.factorize(held["term"])
    share = np.repeat(own["p"].to_numpy(np.int64)[:, None], len(names), axis=1)
    share[np.searchsorted(idx, held["idx"].to_numpy()), codes] = held["p"].to_numpy(np.int64)
    low, high = int(frame["lo"].iloc[0]), int(frame["hi"].iloc[0])
    out = []
    for s in range(len(idx)):
        # two different blocks: only pairs across; one block: all of its pairs
        other = np.flatnonzero((block != block[s]) if low != high else (idx != idx[s]))
        step = share[s] - share[other]
        out.append(pd.DataFrame({"s": idx[s], "t": idx[other], "value": (step * step // share[other]).sum(axis=1, dtype=np.int64)}))
    result = pd.concat(out) if out else pd.DataFrame({"s": [], "t": [], "value": []})
    result.insert(0, "lang", frame["lang"].iloc[0])
    return result.astype({"s": "int64", "t": "int64", "value": "int64"}).assign(n_terms=len(names))


def divergences(df: DataFrame, min_docs: int = 3, top_terms: int = 200, lang_col: str = "lang", source_col: str = "source",
                text_col: str = "text") -> DataFrame:
    """``[lang, source, part, item, value, rank]``: part ``pair`` compares each
    source with every other one of its language, part ``term`` lists the terms
    that it uses more than its language does."""
    counts = stage(sparse_counts(df, lang_col, source_col, text_col), "term-counts")
    words = counts.where(F.col("term").isNotNull())
    vocabulary = stage(words.groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("docs")).where(
        F.col("docs") >= min_docs).select("lang", "term", "lang_n"), "vocabulary")
    langs = vocabulary.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("lang_n").alias("lang_total"))
    kept = stage(words.join(vocabulary, ["lang", "term"]).select("lang", "source", "term", "n", "lang_n"), "kept-terms")

    zero = F.lit(0).cast("bigint")
    groups = counts.where(F.col("term").isNull()).select("lang", "source").join(
        kept.groupBy("lang", "source").agg(F.sum("n").alias("total")), ["lang", "source"], "left").join(langs, "lang", "left")
    groups = stage(groups.select(
        "lang", "source", (F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1).alias("idx"),
        *(F.coalesce(c, zero).alias(c) for c in ("total", "v", "lang_total"))), "groups")
    shares = stage(kept.join(groups, ["lang", "source"]).select(
        "lang", "source", "idx", "term", _share(F.col("n"), F.col("total"), F.col("v")).alias("p"),
        _share(F.col("lang_n"), F.col("lang_total"), F.col("v")).alias("q")), "shares")

    up = shares.where(F.col("p") > F.col("q")).select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"),
                                                     _divergence(F.col("p"), F.col("q")).alias("value"))
    pairs = _pairs(groups, shares).select("lang", "source", F.lit("pair").alias("part"), "item", "value")
    ranked = lambda d: d.withColumn("rank", F.row_number().over(
        Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")))
    return ranked(pairs).unionAll(ranked(up).where(F.col("rank") <= top_terms))


def _pairs(groups: DataFrame, shares: DataFrame) -> DataFrame:
    """``[lang, source, item, value]`` for every ordered pair of sources."""
    most = groups.agg(F.max("v").alias("v"), F.max("idx").alias("idx")).first()
    n_chunks = -(-(most["v"] or 1) // CHUNK_TERMS) or 1
    n_blocks = (most["idx"] or 0) // BLOCK_SOURCES + 1
    block = F.floor(F.col("idx") / BLOCK_SOURCES).cast("int").alias("block")
    absent = F.when(F.col("v") > 0, _share(F.lit(0).cast("bigint"), F.col("total"), F.greatest(F.col("v"), F.lit(1)))
                    ).otherwise(F.lit(1)).cast("bigint")
    marks = groups.select("lang", F.explode(F.sequence(F.lit(0), F.lit(n_chunks - 1))).alias("chunk"), "idx", block,
                          F.lit(None).cast("string").alias("term"), absent.alias("p"))
    cells = shares.select("lang", F.pmod(F.xxhash64("term"), F.lit(n_chunks)).cast("int").alias("chunk"), "idx", block, "term", "p")
    others = F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))).alias("other")
    dealt = marks.unionAll(cells).select("*", others).select(
        "lang", "chunk", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "idx", "block", "term", "p")
    sums = dealt.groupBy("lang", "chunk", "lo", "hi").applyInPandas(
        pair_sums, "lang string, s bigint, t bigint, value bigint, n_terms bigint").groupBy("lang", "s", "t").agg(
        F.sum("value").alias("value"), F.sum("n_terms").alias("n_terms"))
    end = lambda i, name: groups.select("lang", F.col("idx").alias(i), F.col("source").alias(name), absent.alias(f"p_{i}"),
                                        F.col("v").alias(f"v_{i}"))
    return sums.join(end("s", "source"), ["lang", "s"]).join(end("t", "item").drop("v_t"), ["lang", "t"]).select(
        "lang", "source", "item",
        (F.col("value") + (F.col("v_s") - F.col("n_terms")) * _divergence(F.col("p_s"), F.col("p_t"))).alias("value"))
