"""Operator 2: suffix-array deduplication of repeated byte strings.

Every byte that lies in a string of ``width`` bytes which also starts anywhere
else (same document included) is removed.  Steps:

1. *Anchors.*  In every window of ``width`` bytes the leftmost smallest hash of
   a ``SEED``-byte substring marks an anchor (about two in ``width - SEED``
   bytes).  Equal windows choose the same anchor at the same offset, so two
   documents share a window only if they share an anchor and its surroundings.
2. *Contexts.*  The bytes that windows around an anchor can reach are its
   context.  Anchors are counted by (seed, context): an anchor whose whole
   context occurs twice is covered by it entirely; one that shares its seed
   with other contexts needs a closer look; all others are done.
3. *Enhanced suffix array.*  The distinct contexts of a seed are sorted by
   their right part (the suffixes that begin at the anchors); the common
   prefixes of neighbours form an interval tree, found by a stack scan.  Each
   interval is a set of occurrences that share exactly so many bytes to the
   right.  The members of an interval are sorted by what lies to their left;
   runs that agree far enough are covered (``repeated_spans``).
4. *Groups* (``maximal_groups``).  A second stack scan, over the common left
   parts of an interval's members, yields the sets whose left extensions differ;
   those that lie in more than one child interval differ to the right too.  Such
   a set is a maximal repeat with all its occurrences, not only neighbours in
   the array.  Pieces found at several anchors of one repeat are joined.
5. *Spans.*  The union of the covered ranges of a document is removed.

A seed with more than ``HOT`` distinct contexts is split: each context is
replaced by its windows (one row for each offset), which are counted by
pre-aggregation; two equal windows are a repeat.  So no group is collected
without a bound.  Seeds and contexts of more than ``HOT`` anchors are few; they
are joined by a broadcast behind a count, or in ``PARTS`` parts, so that no task
gets all anchors of one.

Defined results: null text is empty; a repeated row repeats every string of
its text; a text shorter than ``width`` loses nothing; other columns are
ignored.  A row is identified by its id and the hash of its text."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cofreq.llm.common import free, map_arrow, stage, utf8
from cofreq.session import is_small

WIDTH = 200
SEED = 32
HOT = 20_000  # distinct contexts of a seed that one task compares
PARTS = 64  # of a hot key, where the hot keys are too many to be broadcast
_P = np.uint64(0x9E3779B97F4A7C15)
_M2, _M3 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M2
    x = (x ^ (x >> np.uint64(27))) * _M3
    return x ^ (x >> np.uint64(31))


_BYTE = _mix(np.arange(1, 257, dtype=np.uint64) * _P)
_PLACE_BITS = 28  # a minimum is taken over (36 bits of hash, place in the chunk)
_PLACE = np.uint64((1 << _PLACE_BITS) - 1)
CHUNK = 1 << 22  # bytes of a text that are scanned at once


def seed_hashes(data: np.ndarray) -> np.ndarray:
    """Hash of the SEED bytes from each position, by doubling."""
    h, step, factor = _BYTE[data], 1, _P
    while step < SEED:
        h = h[:-step] * factor + h[step:]
        step, factor = 2 * step, factor * _M3 | np.uint64(1)
    return _mix(h)


def anchors(data: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions, hashes): the leftmost smallest seed of every window."""
    found = []
    for at in range(0, max(0, len(data) - width + 1), CHUNK):  # chunks share all but one byte of a window
        found.append(_chunk_anchors(data[at:at + CHUNK + width - 1], width, at))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    pos, first = np.unique(np.concatenate([f[0] for f in found]), return_index=True)
    return pos, np.concatenate([f[1] for f in found])[first]


def _chunk_anchors(data: np.ndarray, width: int, at: int) -> tuple[np.ndarray, np.ndarray]:
    with np.errstate(over="ignore"):
        h = seed_hashes(data)
    key = (h & ~_PLACE) | np.arange(len(h), dtype=np.uint64)
    span = width - SEED + 1
    n = len(h) - span + 1
    # running minima from both ends of blocks of ``span`` give every window's minimum
    blocks = -(-len(h) // span)
    grid = np.full(blocks * span, np.iinfo(np.uint64).max, np.uint64)
    grid[:len(h)] = key
    grid = grid.reshape(blocks, span)
    head = np.minimum.accumulate(grid, axis=1).ravel()
    tail = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    place = (np.minimum(tail[:n], head[span - 1:span - 1 + n]) & _PLACE).astype(np.int64)
    place = place[np.concatenate([[True], place[1:] != place[:-1]])]  # places never go back
    return place + at, h[place]


def choosing(text: bytes, p: int, width: int) -> range:
    """Starts of the windows of ``text`` whose anchor is the seed at ``p``."""
    begin = max(0, p - (width - SEED))
    with np.errstate(over="ignore"):
        h = seed_hashes(np.frombuffer(text[begin:p + width], np.uint8)) & ~_PLACE
    k = p - begin
    before, after = np.flatnonzero(h[:k] <= h[k]), np.flatnonzero(h[k + 1:] < h[k])
    first = begin + int(before[-1]) + 1 if len(before) else begin
    last = p + int(after[0]) - (width - SEED) if len(after) else p
    return range(first, min(last, len(text) - width) + 1)


def anchor_rows(docs: DataFrame, width: int) -> DataFrame:
    """``[doc_id, th, pos, seed, ctx]`` of every anchor: row identity, place,
    seed hash and context hash."""
    import xxhash

    back = width - SEED

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        row, pos, seed, ctx = [], [], [], []
        for i, text in enumerate(utf8(batch, "text")):
            text = text or b""
            p, h = anchors(np.frombuffer(text, np.uint8), width)
            row.append(np.full(len(p), i, np.int32))
            pos.append(p)
            seed.append(h)
            begin = np.maximum(p - back, 0)
            # a context cut by an end of the text differs from a whole one
            ctx += [xxhash.xxh3_64_intdigest(text[b:q + width], seed=q - b) for b, q in zip(begin.tolist(), p.tolist())]
        row = np.concatenate(row)
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id").take(pa.array(row)), batch.column("th").take(pa.array(row)),
             pa.array(np.concatenate(pos), pa.int32()), pa.array(np.concatenate(seed).view(np.int64)),
             pa.array(np.array(ctx, np.uint64).view(np.int64))], names=["doc_id", "th", "pos", "seed", "ctx"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_arrow(docs, run, f"doc_id {kind}, th bigint, pos int, seed bigint, ctx bigint")


def common_length(a: np.ndarray, b: np.ndarray, la: np.ndarray, lb: np.ndarray) -> np.ndarray:
    """Length of the common prefix of the rows of two byte matrices."""
    differs = a != b
    first = np.where(differs.any(axis=1), differs.argmax(axis=1), a.shape[1])
    return np.minimum(first, np.minimum(la, lb))


def _matrix(parts: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    size = np.fromiter(map(len, parts), np.int64, len(parts))
    out = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in parts), np.uint8).reshape(len(parts), width)
    return out, size


def interval_tree(lcp: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """All lcp intervals (length, first, last) with length >= ``least`` of a
    suffix array, by a stack scan; ``lcp[i]`` belongs to entries i - 1 and i."""
    out: list[tuple[int, int, int]] = []
    stack: list[tuple[int, int]] = []  # (length, first entry)
    n = len(lcp)
    for i in range(1, n + 1):
        value = int(lcp[i]) if i < n else -1
        first = i - 1
        while stack and stack[-1][0] > value:
            length, first = stack.pop()
            out.append((length, first, i - 1))
        if value >= least and (not stack or stack[-1][0] < value):
            stack.append((value, first))
    return out


class SeedIndex:
    """Enhanced suffix array of the occurrences of one seed: their right parts
    (the bytes from the anchor on) sorted, with the common prefixes of
    neighbours, and their left parts (reversed) for each interval."""

    def __init__(self, left: list[bytes], right: list[bytes], width: int):
        self.m, self.width, self.left, self.right = len(left), width, left, right
        rm, rn = _matrix(right, width)
        self.lm, self.ln = _matrix(left, max(1, width - SEED))
        self.rn = rn
        # ends of texts: shorter rows sort first, and common_length stops at them
        self.sa = np.array(sorted(range(self.m), key=right.__getitem__))
        self.lcp = np.zeros(self.m, np.int64)
        self.lcp[1:] = common_length(rm[self.sa[1:]], rm[self.sa[:-1]], rn[self.sa[1:]], rn[self.sa[:-1]])
        self.by_left = np.empty(self.m, np.int64)
        self.by_left[np.array(sorted(range(self.m), key=left.__getitem__))] = np.arange(self.m)

    def intervals(self) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """(bytes right, members by their left parts, bytes that neighbours
        share to the left, child interval of each member) of every interval
        that holds a repeat."""
        for length, first, last in interval_tree(self.lcp, SEED):
            order = np.argsort(self.by_left[self.sa[first:last + 1]])
            members = self.sa[first:last + 1][order]
            ext = common_length(self.lm[members[1:]], self.lm[members[:-1]], self.ln[members[1:]], self.ln[members[:-1]])
            if (ext + length >= self.width).any():
                child = np.concatenate([[0], np.cumsum(self.lcp[first + 1:last + 1] == length)])
                yield length, members, ext, child[order]

    def reach(self) -> tuple[np.ndarray, np.ndarray]:
        """How far the longest covering repeats reach to the left and right of
        each occurrence (0, 0: none)."""
        reach_l, reach_r = np.zeros(self.m, np.int64), np.zeros(self.m, np.int64)
        for length, members, ext, _ in self.intervals():
            enough = ext + length >= self.width
            kept = np.where(enough, ext, 0)
            best = np.maximum(np.concatenate([[0], kept]), np.concatenate([kept, [0]]))
            hit = np.concatenate([[False], enough]) | np.concatenate([enough, [False]])
            reach_l[members[hit]] = np.maximum(reach_l[members[hit]], best[hit])
            reach_r[members[hit]] = np.maximum(reach_r[members[hit]], length)
        return reach_l, reach_r

    def groups(self) -> Iterator[tuple[int, int, np.ndarray]]:
        """(bytes left, bytes right, members) of every maximal repeat over the
        anchor: its left extensions differ (an interval of the left parts) and
        so do its right ones (it lies in several children).  Each is listed once.
        A repeat none of whose windows has this anchor is left to its others,
        since this one may be no anchor where the repeat occurs elsewhere."""
        for length, members, ext, child in self.intervals():
            least = max(self.width - length, 0)
            for back, first, last in interval_tree(np.concatenate([[0], ext]), least):
                kinds = child[first:last + 1]
                if kinds.min() == kinds.max():
                    continue
                x = members[first]
                if choosing(self.left[x][:back][::-1] + self.right[x][:length], back, self.width):
                    yield back, length, members[first:last + 1]


def _contexts(docs: DataFrame, wanted: DataFrame, width: int, windows: bool) -> DataFrame:
    """The contexts of the wanted anchors ``[doc_id, th, at: array<struct<pos,
    seed>>]``: ``[seed, doc_id, th, pos, left, right]`` (left reversed), or,
    with ``windows``, the hash of every window: ``[win, doc_id, th, start]``."""
    import xxhash

    back = width - SEED
    rows = wanted.withColumnsRenamed({"doc_id": "id2", "th": "th2"})
    joined = docs.join(rows, docs["doc_id"].eqNullSafe(rows["id2"]) & (docs["th"] == rows["th2"])).select(
        "doc_id", "th", "text", "at")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        row, a, b, c, d = [], [], [], [], []
        for i, (text, at) in enumerate(zip(utf8(batch, "text"), batch.column("at").to_pylist())):
            for x in at:
                p = x["pos"]
                if windows:
                    for s in choosing(text, p, width):  # the others belong to other anchors
                        row.append(i)
                        a.append(xxhash.xxh3_128_digest(text[s:s + width]))
                        b.append(s)
                else:
                    row.append(i)
                    a.append(x["seed"])
                    b.append(p)
                    c.append(text[max(0, p - back):p][::-1])
                    d.append(text[p:p + width])
        row = pa.array(row, pa.int32())
        ids = [batch.column("doc_id").take(row), batch.column("th").take(row)]
        if windows:
            return pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), *ids, pa.array(b, pa.int32())],
                                              names=["win", "doc_id", "th", "start"])
        return pa.RecordBatch.from_arrays(
            [pa.array(a, pa.int64()), *ids, pa.array(b, pa.int32()), pa.array(c, pa.binary()), pa.array(d, pa.binary())],
            names=["seed", "doc_id", "th", "pos", "left", "right"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    head = "win binary" if windows else "seed bigint"
    rest = "start int" if windows else "pos int, left binary, right binary"
    return map_arrow(joined, run, f"{head}, doc_id {kind}, th bigint, {rest}", 128)


def _by_seed(batches: Iterable[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
    """The rows of one seed after the other, from batches sorted by seed."""
    rest = None
    for batch in batches:
        frame = batch.to_pandas()
        frame = frame if rest is None else pd.concat([rest, frame], ignore_index=True)
        seeds = frame["seed"].to_numpy()
        cuts = np.flatnonzero(seeds[1:] != seeds[:-1]) + 1
        start = 0
        for cut in cuts:
            yield frame.iloc[start:cut]
            start = cut
        rest = frame.iloc[start:]
    if rest is not None and len(rest):
        yield rest


def _over_seeds(contexts: DataFrame, width: int, groups: bool) -> DataFrame:
    """Enhanced suffix array of every seed's contexts: the longest covering
    ranges ``[doc_id, th, start, end]``, or with ``groups`` the members ``[grp,
    own, doc_id, th, pos, start, end]`` of every maximal repeat (``own``: it is
    the member's whole context)."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[pd.DataFrame] = []
        held = 0
        for g in _by_seed(batches):
            if len(g) < 2:
                continue
            for frame in (_members if groups else _covered)(g, width):
                out.append(frame)
                held += len(frame)
                if held > 20_000:
                    yield pa.RecordBatch.from_pandas(pd.concat(out), schema, preserve_index=False)
                    out, held = [], 0
        if out:
            yield pa.RecordBatch.from_pandas(pd.concat(out), schema, preserve_index=False)

    kind = contexts.schema["doc_id"].dataType
    from pyspark.sql.pandas.types import to_arrow_type

    head = [("grp", pa.string()), ("own", pa.bool_())] if groups else []
    schema = pa.schema([*head, ("doc_id", to_arrow_type(kind)), ("th", pa.int64()),
                        *([("pos", pa.int32())] if groups else []), ("start", pa.int32()), ("end", pa.int32())])
    by_seed = contexts.repartition("seed").sortWithinPartitions("seed")
    name = kind.simpleString()
    return by_seed.mapInArrow(run, f"grp string, own boolean, doc_id {name}, th bigint, pos int, start int, end int" if groups
                              else f"doc_id {name}, th bigint, start int, end int")


def _covered(g: pd.DataFrame, width: int) -> Iterator[pd.DataFrame]:
    to_left, to_right = SeedIndex(g["left"].tolist(), g["right"].tolist(), width).reach()
    hit = to_right > 0
    if hit.any():
        pos = g["pos"].to_numpy()
        yield pd.DataFrame({"doc_id": g["doc_id"], "th": g["th"], "start": pos - to_left, "end": pos + to_right})[hit]


def _members(g: pd.DataFrame, width: int) -> Iterator[pd.DataFrame]:
    index = SeedIndex(g["left"].tolist(), g["right"].tolist(), width)
    for k, (back, ahead, members) in enumerate(index.groups()):
        rows = g.iloc[members]
        own = (index.ln[members] == back) & (index.rn[members] == ahead)
        yield pd.DataFrame({"grp": f"{g['seed'].iloc[0]:x}-{k}", "own": own, "doc_id": rows["doc_id"], "th": rows["th"], "pos": rows["pos"],
                            "start": rows["pos"] - back, "end": rows["pos"] + ahead})


def _hot_and_rest(rows: DataFrame, hot: DataFrame, keys: list[str], spread: str) -> tuple[DataFrame, DataFrame]:
    """``rows`` with one of the few ``hot`` keys, and the others.  The keys are
    broadcast behind a count; beyond that each is joined in ``PARTS`` parts, to
    which the rows are dealt by ``spread``."""
    if is_small(hot):
        side, on = F.broadcast(hot), keys
    else:
        rows = rows.withColumn("__part", F.pmod(F.xxhash64(spread), F.lit(PARTS)))
        side = hot.withColumn("__part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))).cast("bigint"))
        on = [*keys, "__part"]
    return rows.join(side, on, "left_semi").drop("__part"), rows.join(side, on, "left_anti").drop("__part")


def _keyed(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("th"))


def _context_tables(docs: DataFrame, width: int, hot: int) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame | None]:
    """The anchors whose seed occurs twice, ``[doc_id, th, pos, seed, ctx]``,
    their contexts ``[seed, ctx, n, rep]`` (anchors of the context, one of them),
    the contexts of seeds with 2 to ``hot`` of them, and those of seeds with more
    (None: no such seed)."""
    every = stage(anchor_rows(docs, width), "anchors")
    often = stage(every.groupBy("seed").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > 1), "seeds")
    own, rest = _hot_and_rest(every, often.where(F.col("c") > hot).select("seed"), ["seed"], "ctx")
    light = rest.join(often.where(F.col("c") <= hot).select("seed"), "seed", "left_semi")
    cand = stage(light.withColumn("heavy", F.lit(False)).unionByName(own.withColumn("heavy", F.lit(True))), "candidates")
    free(every, often)
    ctx = stage(cand.groupBy("seed", "ctx", "heavy").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct("doc_id", "th", "pos")).alias("rep")), "contexts")
    # only a seed with more than ``hot`` anchors can have more than ``hot`` contexts
    several = ctx.groupBy("seed", "heavy").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > 1)
    few = ctx.where(~F.col("heavy")).join(several.where(~F.col("heavy")).select("seed"), "seed", "left_semi")
    wide = stage(several.where("heavy"), "heavy")
    if wide.limit(1).count() == 0:
        return cand, ctx, few, None
    many, rest = _hot_and_rest(ctx.where("heavy"), wide.where(F.col("m") > hot).select("seed"), ["seed"], "ctx")
    few = few.unionByName(rest.join(wide.where(F.col("m") <= hot).select("seed"), "seed", "left_semi"))
    return cand, ctx, few, many if wide.where(F.col("m") > hot).limit(1).count() else None


def _of_whole(cand: DataFrame, ctx: DataFrame, hot: int) -> DataFrame:
    """The anchors whose whole context occurs twice."""
    many, rest = _hot_and_rest(cand, ctx.where(F.col("n") > hot).select("seed", "ctx"), ["seed", "ctx"], "pos")
    return many.unionByName(rest.join(ctx.where((F.col("n") > 1) & (F.col("n") <= hot)).select("seed", "ctx"),
                                      ["seed", "ctx"], "left_semi"))


def _wanted(open_: DataFrame) -> DataFrame:
    """One occurrence of each context, gathered by document."""
    rows = open_.select("rep.doc_id", "rep.th", F.struct("rep.pos", "seed").alias("x"))
    return stage(rows.groupBy("doc_id", "th").agg(F.collect_list("x").alias("at")), "wanted")


def repeated_spans(df: DataFrame, width: int = WIDTH, hot: int = HOT, id_col: str = "doc_id",
                   text_col: str = "text") -> DataFrame:
    """``[doc_id, th, spans]`` for the documents with a repeat: unmerged byte
    ranges to remove."""
    docs = _keyed(df, id_col, text_col)
    cand, ctx, few, many = _context_tables(docs, width, hot)
    spans = _of_whole(cand, ctx, hot).select(
        "doc_id", "th", F.greatest(F.col("pos") - (width - SEED), F.lit(0)).alias("start"), (F.col("pos") + width).alias("end"))
    # contexts that share their seed with others are looked at closer
    spans = spans.unionAll(_over_seeds(_contexts(docs, _wanted(few), width, False), width, False))
    if many is not None:
        wins = stage(_contexts(docs, _wanted(many), width, True), "windows")
        twice = wins.groupBy("win").agg(F.count_distinct("doc_id", "th", "start").alias("c")).where(F.col("c") > 1).select("win")
        spans = spans.unionAll(wins.join(twice, "win", "left_semi").select(
            "doc_id", "th", "start", (F.col("start") + width).alias("end")))
    return spans.groupBy("doc_id", "th").agg(F.collect_list(F.struct("start", "end")).alias("spans"))


def maximal_groups(df: DataFrame, width: int = WIDTH, hot: int = HOT, id_col: str = "doc_id",
                   text_col: str = "text") -> DataFrame:
    """The repeats of at least ``width`` bytes with all their occurrences:
    ``[repeat, n, length, doc_id, th, start]``, one row for each occurrence (byte
    places; rows equal in id and text are one place).

    Found at each anchor are the contexts that occur twice as a whole and, among
    the contexts of a seed, the maximal repeats over the anchor (for a seed with
    more than ``hot`` contexts: the windows that occur twice).  Pieces with the
    same occurrences that overlap are joined, which makes a repeat of any length
    one group.  Where a middle part longer than a context has more occurrences
    than the whole, the whole is listed as the parts on either side of it."""
    docs = _keyed(df, id_col, text_col)
    cand, ctx, few, many = _context_tables(docs, width, hot)
    back = width - SEED
    found = stage(_over_seeds(_contexts(docs, _wanted(few), width, False), width, True).select(
        "grp", "own", F.struct("doc_id", "th", "pos").alias("rep"), (F.col("pos") - F.col("start")).alias("l"),
        (F.col("end") - F.col("pos")).alias("r")), "groups")
    # a whole context that is part of another one has a group with that one's occurrences too
    alone = ctx.join(found.where("own").select("rep").distinct(), "rep", "left_anti")
    found = found.drop("own")
    if many is not None:
        alone = alone.join(many.select("rep"), "rep", "left_anti")  # all its windows have groups
        wins = _contexts(docs, _wanted(many), width, True).withColumn("row", F.struct("doc_id", "th")).select("win", "row", "start")
        places = many.select(F.struct("rep.doc_id", "rep.th").alias("row"), "rep.pos")
        at = wins.join(places, "row").where(F.col("start").between(F.col("pos") - back, F.col("pos")))
        found = found.unionByName(at.select(
            F.concat(F.lit("w"), F.hex("win")).alias("grp"), F.struct("row.doc_id", "row.th", "pos").alias("rep"),
            (F.col("pos") - F.col("start")).alias("l"), (F.col("start") + width - F.col("pos")).alias("r")))
    whole = _of_whole(cand, alone, hot).select(
        F.concat(F.lit("c"), F.hex("seed"), F.lit("-"), F.hex("ctx")).alias("grp"), "doc_id", "th",
        F.greatest(F.col("pos") - back, F.lit(0)).alias("start"), (F.col("pos") + width).alias("end"))
    # every anchor with the context of a member is an occurrence
    like = found.join(ctx.select("rep", "seed", "ctx"), "rep").select("grp", "l", "r", "seed", "ctx")
    others = like.join(cand, ["seed", "ctx"]).select(
        "grp", "doc_id", "th", (F.col("pos") - F.col("l")).alias("start"), (F.col("pos") + F.col("r")).alias("end"))
    return _joined_pieces(stage(whole.unionByName(others).distinct(), "pieces"), docs)


def _joined_pieces(pieces: DataFrame, docs: DataFrame) -> DataFrame:
    """Groups ``[grp, doc_id, th, start, end]`` of equal ranges; those that have
    the same occurrences but for a shift, and overlap, become one."""
    h, start = F.xxhash64("doc_id", "th").cast("decimal(20,0)"), F.col("start").cast("decimal(10,0)")
    groups = pieces.groupBy("grp").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct("doc_id", "th", "start", "end")).alias("rep"),
        F.sum(h).alias("who"), F.sum("start").alias("places"), F.sum(h * start).alias("where")).where(F.col("n") > 1)
    first = F.col("rep.start")
    # shifts cancel out, so two groups with equal occurrences have equal keys
    shape = groups.select("grp", "n", "rep.doc_id", "rep.th", "rep.start", "rep.end", "who",
                          (F.col("places") - F.col("n") * first).alias("places"),
                          (F.col("where") - F.col("who") * first.cast("decimal(10,0)")).alias("where"))
    same = ["doc_id", "th", "n", "who", "places", "where"]
    w = Window.partitionBy(*same).orderBy("start", F.desc("end"), "grp")
    before = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    islands = shape.withColumn("new", (before.isNull() | (F.col("start") > before)).cast("int")).withColumn(
        "island", F.sum("new").over(w))
    joined = islands.groupBy(*same, "island").agg(
        F.min(F.struct("start", F.negative("end"), "grp")).alias("lead"), F.max("end").alias("end"))
    size = docs.select(F.struct("doc_id", "th").alias("row"), F.octet_length("text").alias("size")).distinct()
    lead = joined.withColumn("row", F.struct("doc_id", "th")).join(size, "row").select(
        F.col("lead.grp").alias("repeat"), "n", (F.least("end", "size") - F.col("lead.start")).alias("length"))
    members = pieces.select(F.col("grp").alias("repeat"), "doc_id", "th", "start")
    return lead.join(members, "repeat").select("repeat", "n", "length", "doc_id", "th", "start")


def merged(spans: list[dict] | None, size: int) -> list[tuple[int, int]]:
    """Disjoint byte ranges in order, within a text of ``size`` bytes."""
    out: list[tuple[int, int]] = []
    for a, b in sorted((s["start"], min(s["end"], size)) for s in spans or ()):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _with_spans(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """``docs`` (with ``doc_id`` and ``th``) and the spans of each row."""
    s = spans.select(F.col("doc_id").alias("__cofreq_id"), F.col("th").alias("__cofreq_th"), F.col("spans").alias("__cofreq_spans"))
    return docs.join(s, docs["doc_id"].eqNullSafe(s["__cofreq_id"]) & (docs["th"] == s["__cofreq_th"]), "left")


def digest(df: DataFrame, spans: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``[doc_id, n_bytes, n_removed, n_spans, kept_sha256]`` for every row.
    (The texts are dealt by the same key as for the contexts, so Spark reuses
    that exchange.)"""
    base = _keyed(df, id_col, text_col)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        size, removed, count, sha = [], [], [], []
        for text, found in zip(utf8(batch, "text"), batch.column("__cofreq_spans").to_pylist()):
            text, h, at = text or b"", hashlib.sha256(), 0
            cut = merged(found, len(text))
            for a, b in cut:
                h.update(text[at:a])
                at = b
            h.update(text[at:])
            size.append(len(text))
            removed.append(sum(b - a for a, b in cut))
            count.append(len(cut))
            sha.append(h.hexdigest())
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), *(pa.array(x, pa.int64()) for x in (size, removed, count)), pa.array(sha, pa.string())],
            names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    kind = base.schema["doc_id"].dataType.simpleString()
    joined = _with_spans(base, spans).select("doc_id", "text", "__cofreq_spans")
    return map_arrow(joined, run,
                     f"doc_id {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string")


def strip(df: DataFrame, spans: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``df`` with the spans removed from its text (bytes of a character cut
    in two go too); a null text stays null."""
    s = spans.select(F.col("doc_id").alias("__cofreq_id"), F.col("th").alias("__cofreq_th"), F.col("spans").alias("__cofreq_spans"))
    joined = df.join(s, F.col(id_col).eqNullSafe(F.col("__cofreq_id")) & (F.xxhash64(text_col) == F.col("__cofreq_th")), "left")
    schema = df.schema

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = []
        for text, found in zip(utf8(batch, text_col), batch.column("__cofreq_spans").to_pylist()):
            if text is not None and found:
                parts, at = [], 0
                for a, b in merged(found, len(text)):
                    parts.append(text[at:a])
                    at = b
                text = b"".join([*parts, text[at:]])
            texts.append(None if text is None else text.decode("utf-8", "ignore"))
        cols = [pa.array(texts, pa.string()) if f.name == text_col else batch.column(f.name) for f in schema]
        return pa.RecordBatch.from_arrays(cols, names=[f.name for f in schema])

    return map_arrow(joined, run, schema)
