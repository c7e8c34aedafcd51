"""Operator 3: n-gram Jaccard join with token-combination prefixes.

A document is the set of its distinct word n-grams (64-bit hashes); documents
with equal sets form one class, and classes are joined.  Steps:

1. *Order.*  Mergeable Misra-Gries summaries over all documents mark every
   n-gram that ``RARE`` documents hold (``summaries``; a bitmap of bounded size).
   The global order puts marked n-grams last and goes by hash otherwise.  Any
   order gives the same links; this one keeps shared passages out of the
   prefixes, at every size of the table.
2. *Prefixes.*  Two sets with similarity >= t share at least k n-grams among
   the first ``n - ceil(t n) + k`` of each (k = 2).  The classes of each prefix
   n-gram are counted exactly: n-grams of at most ``RARE`` classes are index
   keys by themselves; if two linked sets share none of those, they share k
   frequent ones, so frequent n-grams are indexed as combinations of k.  Sets
   so large that combinations would be too many (more than ``COMBINED`` prefix
   n-grams) use single frequent n-grams, sets near that size use both, so that a
   linked pair always has a key in common.
3. *Rare keys.*  All pairs under a rare key (at most ``RARE`` classes) whose
   places leave room for enough common n-grams: of the first rare n-gram that
   two linked sets share, none of the rare ones before it are common.
4. *Frequent keys.*  First every class of a frequent n-gram and size class is
   paired with one common partner only (a few rounds, each with another
   partner), which links a group of near copies in linear work.  Only n-grams
   whose classes are still in different components are combined; pairs in
   different components are tested under the combined keys.
5. *Verification.*  Pairs pass a size test and parity-bitmap tests (bounds, never
   approximations), then the whole sets are compared.

Defined results: null, empty and blank texts have an empty set and are linked
with nothing (component: own id); fewer than n words are one n-gram; repeated
rows are members of one class; a null id gets the smallest id of its component
(null if there is none); other columns are ignored."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cofreq.llm.common import ARROW_ROWS, free, map_arrow, stage
from cofreq.llm.components import components
from cofreq.llm.summaries import M1 as _M1
from cofreq.llm.summaries import frequent_hashes, hash_bitmap, in_bitmap
from cofreq.llm.summaries import mix as _mix

RARE = 24  # classes up to which an n-gram is an index key by itself
COMBINED = 65  # prefix n-grams up to which frequent ones are combined
ROUNDS = 3  # rounds of pairs with one common partner
SMALL = 200_000  # rows up to which a counted side is broadcast
PARITY_BITS = 1024


def ngram_sets(texts: pa.Array, n: int) -> list[np.ndarray]:
    """Sorted distinct n-gram hashes of each text (A-Z lower-cased, words
    between ASCII blanks)."""
    import xxhash

    words = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    coded = words.values.dictionary_encode()
    vocabulary = pc.cast(coded.dictionary, pa.binary()).to_pylist()
    digest = np.fromiter(map(xxhash.xxh3_64_intdigest, vocabulary), np.uint64, len(vocabulary))
    real = np.fromiter(map(len, vocabulary), np.int64, len(vocabulary)) > 0
    at = coded.indices.to_numpy(zero_copy_only=False)
    offsets = words.offsets.to_numpy() - words.offsets[0].as_py()
    keep = real[at]
    if not keep.all():  # empty strings beside leading and trailing blanks
        offsets = np.concatenate([[0], np.cumsum(keep)])[offsets]
        at = at[keep]
    h = digest[at]
    with np.errstate(over="ignore"):
        gram = _mix(h[:max(0, len(h) - n + 1)] + _M1)
        for i in range(1, n):
            gram = _mix(gram * _M1 + h[i:len(h) - n + 1 + i] + np.uint64(i))
        out = []
        for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
            if b - a >= n:
                out.append(np.unique(gram[a:b - n + 1]))
            elif b > a:
                x = np.uint64(b - a)
                for v in h[a:b]:
                    x = _mix(np.array([x * _M1 + v]))[0]
                out.append(np.array([x]))
            else:
                out.append(np.zeros(0, np.uint64))
    return out


def marked_grams(docs: DataFrame, n: int) -> tuple[np.ndarray, int]:
    """A bitmap of the n-grams that ``RARE`` documents or more hold (and of a
    few others), and the number of leading hash bits it is over."""
    mass = max(1, (docs.agg(F.sum(F.octet_length("text").cast("bigint"))).first()[0] or 0) // 6)

    def hashes(batch: pa.RecordBatch):
        for i in range(0, batch.num_rows, ARROW_ROWS):
            yield from ngram_sets(batch.column("text").slice(i, ARROW_ROWS), n)

    found = stage(frequent_hashes(docs.select("text"), hashes, RARE, mass), "marked")
    bitmap = hash_bitmap(found, RARE, mass)
    free(found)
    return bitmap


def prefix_grams(grams: np.ndarray, late: np.ndarray, num: int, den: int) -> np.ndarray:
    """The first n-grams of one set in the global order, one more (k = 2) than
    linked sets need to share one; ``late`` marks those that come last."""
    n = len(grams)
    if n * (den - num) < num:  # no other set can reach the similarity
        return grams[:0]
    return grams[np.lexsort((grams, late))[:n - -(-num * n // den) + 2]]


def parity(grams: np.ndarray) -> np.ndarray:
    """Parity of the number of n-grams in each of 1024 cells, as bytes."""
    odd = np.bincount((grams & np.uint64(PARITY_BITS - 1)).astype(np.int64), minlength=PARITY_BITS) & 1
    return np.packbits(odd.astype(np.uint8))


def _words() -> list[str]:
    return [f"w{i}" for i in range(PARITY_BITS // 64)]


def signatures(docs: DataFrame, n: int, num: int, den: int, marked: tuple[np.ndarray, int]) -> DataFrame:
    """``[doc_id, n, fp, keys, w0, w1, ...]``: set size, fingerprint (null if
    empty), prefix n-grams, parity bitmap in words of 64 cells."""
    import xxhash

    names = _words()

    shared = docs.sparkSession.sparkContext.broadcast(marked)  # at most 128 MB

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        marks = shared.value
        fp, size, keys, bit_rows = [], [], [], []
        for g in ngram_sets(batch.column("text"), n):
            often = in_bitmap(g, *marks)
            size.append(len(g))
            fp.append(xxhash.xxh3_128_digest(g.tobytes()) if len(g) else None)
            keys.append(prefix_grams(g, often, num, den).view(np.int64))
            bit_rows.append(parity(g).tobytes())
        ends = np.concatenate([[0], np.cumsum([len(k) for k in keys])]).astype(np.int32)
        words = np.frombuffer(b"".join(bit_rows), np.int64).reshape(len(size), -1)
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(size, pa.int64()), pa.array(fp, pa.binary()),
             pa.ListArray.from_arrays(ends, pa.array(np.concatenate(keys))), *(pa.array(w) for w in words.T)],
            names=["doc_id", "n", "fp", "keys", *names])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_arrow(docs, run, f"doc_id {kind}, n bigint, fp binary, keys array<bigint>, " + ", ".join(f"{w} bigint" for w in names))


def _sets(docs: DataFrame, n: int) -> DataFrame:
    """``[fp, grams]``: whole sets, for verification."""
    import xxhash

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [g.tobytes() for g in ngram_sets(batch.column("text"), n) if len(g)]
        return pa.RecordBatch.from_arrays([pa.array([xxhash.xxh3_128_digest(g) for g in found], pa.binary()),
                                           pa.array(found, pa.binary())], names=["fp", "grams"])

    return map_arrow(docs.select("text"), run, "fp binary, grams binary")


class _Classes:
    """Classes of equal sets, with what is needed to verify pairs of them."""

    def __init__(self, docs: DataFrame, n: int, num: int, den: int):
        self.docs, self.n, self.num, self.den = docs, n, num, den
        sig = stage(signatures(docs, n, num, den, marked_grams(docs, n)), "signatures")
        salt = 0  # a class is named by 64 bits; should two share a name, all are named anew
        while True:
            self.sig = sig.withColumn("c", F.when(F.col("fp").isNotNull(), F.xxhash64("fp", F.lit(salt))))
            names = self.sig.groupBy("c").agg(F.min("fp").alias("lo"), F.max("fp").alias("hi"))
            if not names.where(F.col("lo") != F.col("hi")).limit(1).count():
                break
            salt += 1
        self.one = stage(self.sig.where(F.col("c").isNotNull()).groupBy("c").agg(
            F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies"), F.first("n").alias("n"),
            *(F.first(w).alias(w) for w in _words())), "classes")

        self.staged: list[DataFrame] = []

    def _own(self, df: DataFrame, label: str) -> DataFrame:
        self.staged.append(stage(df, label))
        return self.staged[-1]

    def drop(self) -> list[DataFrame]:
        """The tables that verification wrote since the last call."""
        staged, self.staged = self.staged, []
        return staged

    def postings(self) -> DataFrame:
        """``[pos, key, c, n]``, once for each class (repeated ids apart); ``pos``
        is the place of the n-gram in the global order."""
        copies = self.one.where(F.col("copies") > 1).select("c", F.col("doc_id").alias("first"))
        copies = F.broadcast(copies) if copies.count() <= SMALL else copies
        rows = self.sig.where(F.size("keys") > 0).join(copies, "c", "left").where(
            F.col("first").isNull() | (F.col("doc_id") == F.col("first")))
        return rows.select(F.posexplode("keys").alias("pos", "key"), "c", "n")

    def possible(self, pairs: DataFrame) -> DataFrame:
        """The pairs whose parity bitmaps allow the similarity (a bound)."""
        words = _words()
        side = lambda c: self.one.select(F.col("c").alias(c), F.col("n").alias(f"n_{c}"), *(F.col(w).alias(f"{w}_{c}") for w in words))
        differ = sum((F.bit_count(F.col(f"{w}_a").bitwiseXOR(F.col(f"{w}_b"))) for w in words), F.lit(0))
        return pairs.join(side("a"), "a").join(side("b"), "b").where(
            differ * (self.num + self.den) <= (F.col("n_a") + F.col("n_b")) * (self.den - self.num)).select("a", "b")

    def verified(self, pairs: DataFrame) -> DataFrame:
        """The pairs ``[a, b]`` whose similarity is at least num / den, by the
        whole sets of one document of each class concerned."""
        pairs = self._own(self.possible(pairs), "pairs")
        wanted = pairs.select(F.explode(F.array("a", "b")).alias("c")).distinct()
        who = self._own(self.one.join(wanted, "c", "left_semi").select("doc_id", "c"), "concerned")
        # a class of rows without id is found by its fingerprint alone
        nameless = who.where(F.col("doc_id").isNull()).limit(1).count() > 0
        ids = who.where(F.col("doc_id").isNotNull()).select("doc_id").distinct()
        ids = F.broadcast(ids) if ids.count() <= SMALL else ids
        docs = self.docs.join(ids, "doc_id", "left_semi")
        docs = docs.unionAll(self.docs.where(F.col("doc_id").isNull())) if nameless else docs
        names = self.sig.select("fp", "c").join(wanted, "c", "left_semi").dropDuplicates(["c"])
        sets = self._own(_sets(docs, self.n).join(names, "fp").select("c", "grams").dropDuplicates(["c"]), "sets")
        num, den = self.num, self.den

        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            keep = []
            for x, y in zip(batch.column("grams_a").to_pylist(), batch.column("grams_b").to_pylist()):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both_n = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(den * both_n >= num * (len(x) + len(y) - both_n))
            return batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

        side = lambda c: sets.select(F.col("c").alias(c), F.col("grams").alias(f"grams_{c}"))
        return map_arrow(pairs.join(side("a"), "a").join(side("b"), "b"), run, "a bigint, b bigint", 256)


def shared_postings(posting: DataFrame) -> DataFrame:
    """``[key, pos, c, n, m]``: the prefix n-grams that several classes have,
    with their number m.  Counts are pre-aggregated, so a hot n-gram is one row
    a task."""
    shared = posting.groupBy("key").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > 1)
    return stage(posting.join(shared, "key"), "postings")


def rare_pairs(known: DataFrame, num: int, den: int) -> DataFrame:
    """``[a, b]``: classes that share a rare n-gram at places which leave room
    for a link.  Frequent n-grams of a class may be common before that place, so
    they are not counted."""
    often = known.where(F.col("m") > RARE).groupBy("c").agg(F.count(F.lit(1)).alias("often"))
    often = F.broadcast(often) if often.count() <= SMALL else often
    rows = known.where(F.col("m") <= RARE).join(often, "c", "left").select(
        "key", "c", "n", (F.col("n") - F.greatest(F.col("pos") - F.coalesce("often", F.lit(0)), F.lit(0))).alias("left"))
    other = rows.select("key", F.col("c").alias("c2"), F.col("n").alias("n2"), F.col("left").alias("left2"))
    return rows.join(other, "key").where(
        (F.col("c") < F.col("c2"))
        & (F.least("left", "left2") * (num + den) >= (F.col("n") + F.col("n2")) * num)).select(
        F.col("c").alias("a"), F.col("c2").alias("b")).distinct()


def frequent_keys(often: DataFrame, one: DataFrame, num: int, den: int) -> DataFrame:
    """``[key, c, n, label, left, first, own, w0, w1, ...]`` from frequent prefix
    n-grams ``[key, pos, c, n, label]`` and the classes' parity bitmaps: pairs of
    them, and single ones of large sets; only keys of several labels, at places
    that leave room for a link with the smallest set under them.  ``left`` is the
    number of n-grams from the (first) one on; ``own`` lists the n-grams of the
    class in the global order and ``first`` the combined two (both null for
    single ones).

    Two linked classes with different labels have no rare n-gram in common, so of
    the n-grams before the second frequent one that they share they share one:
    that place alone decides whether a combination can be the first of a link."""
    words = _words()
    bits = one.select("c", *words)
    smallest = often.groupBy("key").agg(F.min("n").alias("least"), F.min("label").alias("lo"), F.max("label").alias("hi"))
    rows = often.join(smallest.where(F.col("lo") != F.col("hi")).select("key", "least"), "key")
    # n-grams that a link with a set of that size needs in common
    needed = lambda least: F.ceil((F.col("n") + F.greatest(least, F.ceil(F.col("n") * num / den))) * num / (num + den))
    # sets this large, or that a set this large can be linked with
    large = rows.where((F.col("n") * (den - num) >= COMBINED * num) & (F.col("n") - F.col("pos") >= needed(F.col("least")))).join(bits, "c")
    prefix = F.col("n") - F.ceil(F.col("n") * num / den) + 1
    own = rows.where(prefix <= COMBINED).groupBy("c", "n", "label").agg(
        F.array_sort(F.collect_set(F.struct("pos", "key", "least"))).alias("at")).where(F.size("at") > 1)
    room = lambda x, y: F.col("n") - y["pos"] + 1 >= needed(F.greatest(x["least"], y["least"]))
    both = F.flatten(F.transform("at", lambda x, i: F.transform(
        F.filter(F.slice("at", i + 2, F.size("at")), lambda y: room(x, y)),
        lambda y: F.struct((F.col("n") - x["pos"]).alias("left"), F.array(x["key"], y["key"]).alias("first")))))
    pairs = own.join(bits, "c").select("c", "n", "label", F.col("at.key").alias("own"), *words, F.explode(both).alias("two")).select(
        F.xxhash64("two.first").alias("key"), "c", "n", "label", "two.left", "two.first", "own", *words)
    none = F.lit(None).cast("array<bigint>")
    return large.select("key", "c", "n", "label", (F.col("n") - F.col("pos")).alias("left"), none.alias("first"),
                        none.alias("own"), *words).unionAll(still_open(pairs))


def still_open(rows: DataFrame) -> DataFrame:
    """The rows ``[key, c, label, ...]`` under keys of several components."""
    keys = rows.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where(F.col("lo") != F.col("hi"))
    return rows.join(keys.select("key"), "key", "left_semi")


def open_pairs(left: DataFrame, num: int, den: int) -> DataFrame:
    """``[c, other]``: classes under one key of ``frequent_keys``, in different
    components, whose sizes, places and whole parity bitmaps allow a link.  Two
    classes have no rare n-gram in common here, so before the first frequent one
    that they share they have none; a pair is taken under its first combination
    only."""
    words = _words()
    right = left.select("key", *(F.col(c).alias(f"{c}_b") for c in ("c", "n", "label", "left", "own", *words)))
    differ = sum((F.bit_count(F.col(w).bitwiseXOR(F.col(f"{w}_b"))) for w in words), F.lit(0))
    return left.join(right, "key").where(
        (F.col("c") < F.col("c_b")) & (F.col("label") != F.col("label_b"))
        & (F.least("left", "left_b") * (num + den) >= (F.col("n") + F.col("n_b")) * num)
        & (differ * (num + den) <= (F.col("n") + F.col("n_b")) * (den - num))
        & F.coalesce(F.slice(F.array_intersect("own", "own_b"), 1, 2) == F.col("first"), F.lit(True))
    ).select("c", F.col("c_b").alias("other"))


def _labelled(members: DataFrame, labels: DataFrame | None) -> DataFrame:
    if labels is None:
        return members.withColumn("label", F.col("c"))
    return members.join(labels, "c", "left").withColumn("label", F.coalesce("label", "c"))


def _merge(labels: DataFrame | None, links: DataFrame) -> DataFrame:
    """``[c, label]`` after adding ``links[a, b]``: components of the links
    between labels, so that later rounds work on little."""
    if labels is None:
        return stage(components(links).select(F.col("node").alias("c"), "label"), "labels")
    ends = links
    for end in "ab":
        ends = ends.join(labels.select(F.col("c").alias(end), F.col("label").alias("l")), end, "left").withColumn(
            end, F.coalesce("l", end)).drop("l")
    joined = components(ends).select(F.col("node").alias("label"), F.col("label").alias("first"))
    every = labels.unionAll(joined.select(F.col("label").alias("c"), "label").join(labels.select("c"), "c", "left_anti"))
    after = stage(every.join(joined, "label", "left").select("c", F.coalesce("first", "label").alias("label")), "labels")
    free(labels)
    return after


def jaccard_components(df: DataFrame, n: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id",
                       text_col: str = "text") -> DataFrame:
    """``[doc_id, n_shingles, component_id]`` for every row, where documents with
    similarity >= num / den are linked.  Every pair with a common key that its
    bounds allow is verified unless its ends are already in one component."""
    docs = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    classes = _Classes(docs, n, num, den)
    known = shared_postings(classes.postings())
    pair = lambda d: d.select(F.least("c", "other").alias("a"), F.greatest("c", "other").alias("b")).distinct()
    links = stage(classes.verified(rare_pairs(known, num, den)), "verified")
    labels = _merge(None, links)
    often = stage(known.where(F.col("m") > RARE).select("key", "pos", "c", "n"), "frequent")
    free(links, known, *classes.drop())

    # every class of a frequent n-gram and size class with one partner, another in each round
    size_class = F.floor(F.log(F.col("n")) / F.log(F.lit(den / num))).cast("int")
    for turn in range(ROUNDS):
        rows = _labelled(often, labels).withColumn("class", size_class)
        partner = rows.groupBy("key", "class").agg(
            F.min(F.struct(F.xxhash64("c", F.lit(turn)), "c", "label")).alias("p"), F.min("label").alias("lo"),
            F.max("label").alias("hi")).where(F.col("lo") != F.col("hi")).select(
            "key", "class", F.col("p.c").alias("other"), F.col("p.label").alias("label2"))
        near = rows.join(partner, ["key", "class"]).where(F.col("label") != F.col("label2"))
        links = stage(classes.verified(pair(near)), "verified")
        found = links.limit(1).count()
        labels = _merge(labels, links) if found else labels
        free(links, *classes.drop())
        if not found:
            break

    # pairs under the keys of n-grams that are still in different components
    members = stage(frequent_keys(_labelled(often, labels), classes.one, num, den), "members")
    rest = open_pairs(members, num, den)
    links = stage(classes.verified(pair(rest)), "verified")
    labels = _merge(labels, links) if links.limit(1).count() else labels
    free(links, often, members, *classes.drop())
    rows = classes.sig.select("doc_id", "n", "c").join(labels, "c", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("label", "c").alias("label"))
    first = rows.where(F.col("label").isNotNull()).groupBy("label").agg(F.min("doc_id").alias("first"))
    return rows.join(first, "label", "left").select(
        "doc_id", "n_shingles", F.when(F.col("label").isNull(), F.col("doc_id")).otherwise(F.col("first")).alias("component_id"))


def keep_first(df: DataFrame, n: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id",
               text_col: str = "text") -> DataFrame:
    """``df`` with one row of each group of near duplicates: the one with the
    smallest id.  Rows without an id cannot be named and stay, one for each
    text; of repeated rows one stays."""
    found = stage(jaccard_components(df, n, num, den, id_col, text_col).select("doc_id", "component_id"), "components")
    gone = found.where(~F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("__cofreq_gone")).distinct()
    gone = F.broadcast(gone) if gone.count() <= SMALL else gone
    kept = df.join(gone, F.col(id_col) == F.col("__cofreq_gone"), "left_anti")
    if found.groupBy("doc_id").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > 1).limit(1).count():
        kept = kept.withColumn("__cofreq_text", F.xxhash64(text_col)).dropDuplicates([id_col, "__cofreq_text"]).drop("__cofreq_text")
    return kept
