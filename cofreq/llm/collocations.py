"""Operator 11: phrase collocations by mergeable Misra-Gries summaries.

1. *Summaries.*  Every contiguous run of 1 to ``max_words`` words of a piece is a
   64-bit hash of its language and words.  The leading bits of the hash name its
   hash partition; a task sorts the hashes of ``HELD`` occurrences at a time and
   hands back, for each partition, distinct keys with counts, packed.
2. *Merging.*  One pass over the summaries of a partition adds up counts.  When
   more than ``capacity`` counters are held, the value of the counter at that
   place is taken off all of them and those at zero go (Misra-Gries).  Capacity
   is ``HEADROOM`` times mass / threshold.  What was taken off so far is known
   and never passes ``threshold / HEADROOM``; where it would, the summary takes
   more counters instead.  So every phrase with ``threshold`` occurrences is
   among the counters that, with what was taken off, reach the threshold.
3. *Exact counts.*  The survivors become a bitmap of hash prefixes, whose size
   is bounded.  A second pass over the texts counts the phrases that it lets
   through, by their words; phrases below the threshold go.  The bitmap, too,
   can only let too much through.
4. *Scores.*  The parts of a frequent phrase are frequent, so their counts are
   in the same table: joins of phrases, without the texts.

Defined results: null texts are empty, null languages ``und``; empty texts and
pieces have no words; repeated rows count each time; an empty table gives no
rows; a word of any length is a word; other columns are ignored."""

from __future__ import annotations

import string
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cofreq.llm.common import batch_sizes, stage
from cofreq.llm.summaries import M1, frequent_hashes, hash_bitmap, in_bitmap, mix
from cofreq.session import ship_package

MAX_WORDS = 5
HELD_PHRASES = 200_000  # phrases that a task holds before it hands their counts back
PART_PHRASES = 100_000  # phrases whose counts one task adds up, about

_MARKS = b".,;:!?\n\x0b\x0c\r"
_TABLE = bytes(10 if b in _MARKS else 32 if b == 9 else b + 32 if chr(b) in string.ascii_uppercase else b for b in range(256))


class Words:
    """The words of some texts of one language: ``codes`` into ``vocabulary``,
    and the ``piece`` that each word is in."""

    def __init__(self, texts: list[bytes]):
        data = b"\n".join(texts).translate(_TABLE).replace(b"\n", b" \n ")
        words = pc.split_pattern(pa.array([data], pa.large_binary()), b" ").values.dictionary_encode()
        self.vocabulary = words.dictionary.to_pylist()
        at = words.indices.to_numpy(zero_copy_only=False)
        kind = np.fromiter((0 if not w else 1 if w == b"\n" else 2 for w in self.vocabulary), np.int8, len(self.vocabulary))[at]
        self.codes = at[kind == 2]
        self.piece = np.cumsum(kind == 1, dtype=np.int64)[kind == 2]

    def hashes(self, lang: str, max_words: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each number of words: the places where a phrase starts, and the
        hashes of the phrases."""
        import xxhash

        word = np.fromiter(map(xxhash.xxh3_64_intdigest, self.vocabulary), np.uint64, len(self.vocabulary))[self.codes]
        seed = np.uint64(xxhash.xxh3_64_intdigest(lang))
        start, h = np.arange(len(word)), np.full(len(word), seed, np.uint64)
        for n in range(1, max_words + 1):
            if n > 1:
                start = start[:np.searchsorted(start, len(word) - n + 1)]
                inside = self.piece[start + n - 1] == self.piece[start]
                h, start = h[:len(start)][inside], start[inside]
            with np.errstate(over="ignore"):
                h = mix(h * M1 + word[start + n - 1] + np.uint64(n))
            yield n, start, h

    def phrase(self, start: int, n: int) -> bytes:
        return b" ".join([self.vocabulary[c] for c in self.codes[start:start + n].tolist()])


def _by_lang(batch: pa.RecordBatch) -> Iterator[tuple[str, Words]]:
    texts: dict[str, list] = {}
    for lang, text in zip(batch.column("lang").to_pylist(), pc.cast(batch.column("text"), pa.binary()).to_pylist()):
        texts.setdefault(lang, []).append(text)
    for lang, found in texts.items():
        yield lang, Words(found)


def _texts(df: DataFrame, lang_col: str, text_col: str) -> DataFrame:
    return df.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"),
                     F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def survivors(docs: DataFrame, threshold: int, max_words: int, mass: int) -> DataFrame:
    """``[part, key]`` of every phrase of ``docs[lang, text]`` with at least
    ``threshold`` occurrences, and of some others."""
    def hashes(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        for lang, words in _by_lang(batch):
            for _, _, h in words.hashes(lang, max_words):
                yield h

    return frequent_hashes(docs, hashes, threshold, mass)


def exact_counts(docs: DataFrame, bitmap: np.ndarray, bits: int, max_words: int, threshold: int, n_parts: int) -> DataFrame:
    """``[lang, phrase, words, f]``: the phrases that the bitmap lets through and
    that have ``threshold`` occurrences; a null phrase counts all words of its
    language.  Tasks hand back their counts sorted and packed, dealt into
    ``n_parts`` parts by the phrase; the counts of a part are added up in turn."""
    shared = docs.sparkSession.sparkContext.broadcast(bitmap)
    schema = pa.schema([("lang", pa.string()), ("phrase", pa.binary()), ("f", pa.int64())])

    def packed(held: dict) -> pa.RecordBatch:
        dealt: dict[int, list] = {}
        for key in sorted(held):
            dealt.setdefault(zlib.crc32(key[1]) % n_parts, []).append((*key, held[key]))
        return pa.RecordBatch.from_arrays([pa.array(list(dealt), pa.int32()), pa.array(
            [_ipc(pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema))
             for rows in dealt.values()], pa.binary())], names=["part", "counts"])

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        allowed, held = shared.value, {}
        for batch in batches:
            for lang, words in _by_lang(batch):
                if not len(words.codes):
                    continue
                held[lang, b""] = held.get((lang, b""), 0) + len(words.codes)
                for n, start, h in words.hashes(lang, max_words):
                    hit = in_bitmap(h, allowed, bits)
                    for at, f in distinct_phrases(words, start[hit], h[hit], n):
                        key = (lang, words.phrase(at, n))
                        held[key] = held.get(key, 0) + f
                if len(held) >= HELD_PHRASES:
                    yield packed(held)
                    held = {}
        if held:
            yield packed(held)

    def total(tables: list) -> pa.Table:
        return pa.concat_tables(tables).group_by(["lang", "phrase"]).aggregate([("f", "sum")]).rename_columns(schema.names)

    def frequent(tables: list) -> list[pa.RecordBatch]:
        table = total(tables)
        table = table.filter(pc.or_(pc.greater_equal(table["f"], threshold), pc.equal(pc.binary_length(table["phrase"]), 0)))
        phrase = pc.if_else(pc.equal(pc.binary_length(table["phrase"]), 0), None, table["phrase"].cast(pa.string()))
        words = pc.if_else(pc.is_null(phrase), 0, pc.add(pc.count_substring(phrase, " "), 1)).cast(pa.int32())
        made = pa.table({"lang": table["lang"], "phrase": phrase, "words": words, "f": table["f"]})
        return made.combine_chunks().to_batches()

    def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, tables = None, []
        for batch in batches:
            for p, blob in zip(batch.column("part").to_pylist(), batch.column("counts").to_pylist()):
                if p != part and tables:
                    yield from frequent(tables)
                    tables = []
                part = p
                tables.append(pa.ipc.open_stream(blob).read_all())
                if sum(len(t) for t in tables[1:]) > 1_000_000:
                    tables = [total(tables)]
        if tables:
            yield from frequent(tables)

    ship_package(docs.sparkSession)
    found = docs.mapInArrow(count, "part int, counts binary")
    return found.repartition(n_parts, "part").sortWithinPartitions("part").mapInArrow(
        add, "lang string, phrase string, words int, f bigint")


def _ipc(batch: pa.RecordBatch) -> bytes:
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
        writer.write_batch(batch)
    return out.getvalue().to_pybytes()


def distinct_phrases(words: Words, start: np.ndarray, h: np.ndarray, n: int) -> Iterable[tuple[int, int]]:
    """One place and the number of places of each distinct phrase.  Equal hashes
    are compared word by word; should two phrases share one, places are
    counted one by one."""
    _, first, group, size = np.unique(h, return_index=True, return_inverse=True, return_counts=True)
    same = start[first][group]
    if all((words.codes[start + i] == words.codes[same + i]).all() for i in range(n)):
        return zip(start[first].tolist(), size.tolist())
    return zip(start.tolist(), [1] * len(start))


def phrase_counts(df: DataFrame, threshold: int = 100, max_words: int = MAX_WORDS, lang_col: str = "lang",
                  text_col: str = "text") -> DataFrame:
    """``[lang, phrase, words, f]`` for every phrase of 1 to ``max_words`` words
    with at least ``threshold`` occurrences in its language, and one row with a
    null phrase for the number of words of each language."""
    docs = _texts(df, lang_col, text_col)
    n_bytes = docs.agg(F.sum(F.octet_length("text").cast("bigint"))).first()[0] or 0
    mass = max(1, n_bytes * max_words // 6)
    batch_sizes(docs.sparkSession)
    found = stage(survivors(docs, threshold, max_words, mass), "survivors")
    bitmap, bits = hash_bitmap(found, threshold, mass)
    n_parts = max(2 * docs.sparkSession.sparkContext.defaultParallelism, -(-found.count() // PART_PHRASES))
    return exact_counts(docs, bitmap, bits, max_words, threshold, n_parts)


def _words(phrase: Column, first: Column, n: Column) -> Column:
    return F.array_join(F.slice(F.split(phrase, " "), first, n), " ")


def collocations(df: DataFrame, threshold: int = 100, max_words: int = MAX_WORDS, absorbed: int = 100,
                 lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """``[lang, phrase, a, l, r, n, score]`` for every phrase of 2 to
    ``max_words`` words with at least ``threshold`` occurrences that no longer
    such phrase absorbs (one that holds it and has ``absorbed`` per cent of its
    occurrences).  ``score`` is that of the weakest cut, l and r the occurrences
    of its two parts, n the words of the language."""
    counts = stage(phrase_counts(df, threshold, max_words, lang_col, text_col), "phrase-counts")
    totals = counts.where(F.col("phrase").isNull()).select("lang", F.col("f").alias("n"))
    known = counts.where(F.col("phrase").isNotNull())
    longer = known.where(F.col("words") > 1)
    # a phrase inside a longer one lies, too, in one that is longer by one word and at least as frequent
    inner = longer.where(F.col("words") > 2).select("lang", "f", F.explode(F.array(
        _words(F.col("phrase"), F.lit(1), F.col("words") - 1), _words(F.col("phrase"), F.lit(2), F.col("words") - 1))).alias("phrase"))
    inner = inner.groupBy("lang", "phrase").agg(F.max("f").alias("longer_f"))
    left = longer.join(inner, ["lang", "phrase"], "left").where(
        F.col("longer_f").isNull() | (F.col("longer_f") * 100 < F.col("f") * absorbed)).select("lang", "phrase", "words", F.col("f").alias("a"))

    part = lambda name, f: known.select("lang", F.col("phrase").alias(name), F.col("f").alias(f))
    cuts = left.select("*", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", _words(F.col("phrase"), F.lit(1), F.col("k")).alias("head"),
                       _words(F.col("phrase"), F.col("k") + 1, F.col("words") - F.col("k")).alias("tail"))
    cuts = cuts.join(part("head", "l"), ["lang", "head"]).join(part("tail", "r"), ["lang", "tail"]).join(totals, "lang")
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    score = F.call_function("div", F.lit(1000).cast("decimal(4,0)") * wide("a") * wide("n"), wide("l") * wide("r"))
    weakest = cuts.groupBy("lang", "phrase").agg(F.min(F.struct(score.alias("score"), "k", "a", "l", "r", "n")).alias("cut"))
    return weakest.select("lang", "phrase", "cut.a", "cut.l", "cut.r", "cut.n", "cut.score")


def top_collocations(df: DataFrame, top: int = 2000, **options) -> DataFrame:
    """The first ``top`` of each language by score, then occurrences, then
    phrase (byte order), with ``rank`` from 1."""
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return collocations(df, **options).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).withColumn(
        "rank", F.col("rank").cast("bigint"))
