"""Operator 4: hierarchical multi-length packing.

Every document becomes token ids plus one end id.  Full windows of the longest
tier are cut off first and are sequences by themselves; what remains of a
document (shorter than the longest tier) is one piece, routed to the smallest
tier that holds it.  Tiers are packed from the shortest up: in each tier the
piece that opens a window leaves a gap, which is filled exactly with one or
two shorter pieces; such a sequence has the tier's own length (a power of two:
no padding).  Pieces of a shorter tier that find no exact partner are promoted
and fill the gaps of longer windows.  In the longest tier gaps are filled best
fit.  Sequences are dealt to step groups so that the groups' token counts stay
close: in each packing group they are sorted by length and dealt back and
forth.

Tokens are cut into pieces inside the task that tokenises the document, so
only piece descriptions move.  They are packed in groups of about
``group_pieces`` pieces chosen by hash: no task or driver sees all of them,
and each group leaves one partly filled sequence at most per tier.

Defined results: null and empty texts are the end id alone; repeated rows are
packed as rows of their own; an empty table gives no sequences."""

from __future__ import annotations

import json
import re
import zlib
from functools import cached_property, partial

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cofreq.llm.bpe import byte_symbols, default_path
from cofreq.llm.common import map_arrow, stage

TIERS = (512, 1024, 2048, 4096)
GROUP_PIECES = 40_000
STEP_SEQUENCES = 64  # sequences of one step group, about
END_ID = 2
CACHE_BYTES = 10 << 20  # of words and ids kept per generation in a worker

# words of printable ASCII and Latin-1 letters: lower-casing and composition
# are plain there; all others go through the library
_PLAIN = re.compile(rb"(?:[\n\x21-\x7e]|\xc3[\x80-\xbf])*")
# fixed value: the pre-tokenisation pattern of the vocabulary, without its blanks
_PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\w\s]|_)+")
_END, _SEP = "\x01", "\x02"  # mark the end of a pretoken, and of a word


class WordBpe:
    """Token ids of a lower-casing word BPE, by white-space-separated words
    (they are independent of each other there).  Ids of recent words are kept
    in two generations of bounded size."""

    def __init__(self, path: str | None = None):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import tiktoken

        self.path = path = path or default_path("word_bpe_49k.json")
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        special = {t["content"] for t in spec["added_tokens"]}  # all begin with <|
        end, symbols, ranks = spec["model"]["end_of_word_suffix"], byte_symbols(), {}
        for token, i in spec["model"]["vocab"].items():
            if token not in special:
                last = token.endswith(end)
                body = token[:-len(end)] if last else token
                ranks[bytes(symbols[c] for c in body) + (_END.encode() if last else b"")] = i
        self.sep = ranks[_SEP.encode()]
        self.fast = tiktoken.Encoding("words", pat_str=rf"[^{_END}{_SEP}]+{_END}|{_SEP}", mergeable_ranks=ranks,
                                      special_tokens={})
        self.young: dict[bytes, bytes] = {}
        self.young_bytes = 0
        self.old: dict[bytes, bytes] = {}

    @cached_property
    def whole(self):
        """The library's tokenizer, for the words that need it."""
        from tokenizers import Tokenizer

        whole = Tokenizer.from_file(self.path)
        whole.no_truncation()
        whole.no_padding()
        return whole

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts of a string array (unsigned 32-bit, one after
        another) and the offsets of the texts in them."""
        split = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        coded = split.values.dictionary_encode()
        if self.young_bytes > CACHE_BYTES:
            self.old, self.young, self.young_bytes = self.young, {}, 0
        words = pc.cast(coded.dictionary, pa.binary()).to_pylist()
        missing = set(words).difference(self.young)
        if missing:
            self._learn(missing)
        known = [self.young[w] for w in words]  # once for each distinct word of the batch
        size = np.fromiter(map(len, known), np.int64, len(known)) // 4
        first = np.cumsum(size) - size
        pool = np.frombuffer(b"".join(known), "<u4")
        at = coded.indices.to_numpy(zero_copy_only=False)
        n = size[at]
        ends = np.concatenate([[0], np.cumsum(n)])
        ids = pool[np.repeat(first[at] - ends[:-1], n) + np.arange(ends[-1])]
        return ids, ends[split.offsets.to_numpy() - split.offsets[0].as_py()]

    def _learn(self, missing: set[bytes]) -> None:
        self.young_bytes += 120 * len(missing)  # of the table itself, and of short words
        for w in missing & self.old.keys():
            self.young[w] = self.old[w]
        missing = [w for w in missing if w not in self.old]
        joined = b"\n".join(missing)
        if _PLAIN.fullmatch(joined) and b"<|" not in joined:
            plain, odd = missing, []
        else:
            plain = [w for w in missing if _PLAIN.fullmatch(w) and b"<|" not in w]
            odd = list(set(missing).difference(plain))
            joined = b"\n".join(plain)
        if plain:
            marked = _PIECES.sub(rf"\g<0>{_END}", joined.decode().lower()).replace("\n", _SEP)
            ids = np.array(self.fast.encode_ordinary(marked), "<u4")
            raw, cut = ids.tobytes(), np.flatnonzero(ids == self.sep)
            self.young_bytes += len(joined) + len(raw)
            begin = np.concatenate([[0], 4 * (cut + 1)]).tolist()
            end = np.append(4 * cut, len(raw)).tolist()
            self.young.update(zip(plain, [raw[i:j] for i, j in zip(begin, end)]))
        for w, e in zip(odd, self.whole.encode_batch([w.decode("utf-8", "replace") for w in odd],
                                                     add_special_tokens=False) if odd else ()):
            self.young[w] = np.array(e.ids, "<u4").tobytes()
            self.young_bytes += len(w) + len(self.young[w])


def pieces(df: DataFrame, path: str | None = None, window: int = TIERS[-1], id_col: str = "doc_id",
           text_col: str = "text") -> DataFrame:
    """``[doc_id, start, length, ids_crc32, doc_tokens]``: full windows and the
    rest of every row."""
    rows = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def cut(bpe: WordBpe, batch: pa.RecordBatch) -> pa.RecordBatch:
        at, start, length, crc, total = [], [], [], [], []
        ids, ends = bpe.encode(batch.column("text"))
        for row in range(batch.num_rows):
            own = np.append(ids[ends[row]:ends[row + 1]], np.uint32(END_ID))
            n = len(own)
            for s in range(0, n, window):
                part = own[s:s + window]
                at.append(row)
                start.append(s)
                length.append(len(part))
                crc.append(zlib.crc32(part.tobytes()))
                total.append(n)
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id").take(pa.array(at, pa.int32())),
             *(pa.array(x, pa.int64()) for x in (start, length, crc, total))],
            names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return map_arrow(rows, lambda: partial(cut, WordBpe(path)),
                     f"doc_id {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint", made_by_task=True)


def pack_lengths(lengths: np.ndarray, tiers: tuple[int, ...] = TIERS) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, offset) of each piece; sequences are numbered from 0."""
    top = tiers[-1]
    pool: list[list[int]] = [[] for _ in range(top + 1)]  # piece numbers by length
    for i in np.lexsort((np.arange(len(lengths)), lengths))[::-1]:
        pool[lengths[i]].append(int(i))
    have = sum(1 << n for n in range(1, top + 1) if pool[n])  # bit n: there is a piece of length n
    seq, off, n_seq = np.full(len(lengths), -1, np.int64), np.zeros(len(lengths), np.int64), 0

    def take(n: int) -> int:
        nonlocal have
        i = pool[n].pop()
        if not pool[n]:
            have &= ~(1 << n)
        return i

    def largest(limit: int) -> int:
        return (have & ((1 << (limit + 1)) - 1)).bit_length() - 1 if limit > 0 else 0

    def put(members: list[int]) -> None:
        nonlocal n_seq
        at = 0
        for i in members:
            seq[i], off[i] = n_seq, at
            at += int(lengths[i])
        n_seq += 1

    for tier in tiers[:-1]:  # exact windows of the shorter tiers, from pieces that more than half fill them
        for n in range(tier, tier // 2, -1):
            while pool[n]:
                gap = tier - n
                first = take(n)
                if gap == 0:
                    put([first])
                elif pool[gap]:
                    put([first, take(gap)])
                else:
                    a = largest(gap - 1)
                    if a > 0 and pool[gap - a] and (gap != 2 * a or len(pool[a]) > 1):
                        put([first, take(a), take(gap - a)])
                    else:  # promoted: stays for longer windows
                        pool[n].append(first)
                        have |= 1 << n
                        break
    while have:  # the longest tier: best fit from whatever is left
        gap, members = top, []
        while (n := largest(gap)) > 0:
            members.append(take(n))
            gap -= n
        put(members)
    return seq, off


def pack(df: DataFrame, path: str | None = None, tiers: tuple[int, ...] = TIERS, group_pieces: int = GROUP_PIECES,
         id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``[doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset,
    tier, step_group]`` for every piece."""
    top = tiers[-1]
    made = stage(pieces(df, path, top, id_col, text_col), "pieces")
    n = made.count()
    n_groups = max(1, -(-n // group_pieces))
    kind = made.schema["doc_id"].dataType.simpleString()

    def pack_group(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["doc_id", "start", "ids_crc32", "length"], kind="stable").reset_index(drop=True)
        length = group["length"].to_numpy(np.int64)
        seq, off = pack_lengths(length, tiers)
        total = np.bincount(seq, length).astype(np.int64)
        base = int(group["grp"].iloc[0]) << 32
        tier = np.array(tiers)[np.searchsorted(tiers, total)]
        # step groups: by falling length, dealt back and forth
        steps = max(1, len(total) // STEP_SEQUENCES)
        rank = np.empty(len(total), np.int64)
        rank[np.argsort(-total, kind="stable")] = np.arange(len(total))
        turn, place = rank // steps, rank % steps
        step = np.where(turn % 2 == 0, place, steps - 1 - place)
        return group.drop(columns="grp").assign(sequence_id=base + seq, offset=off, tier=tier[seq].astype(np.int32),
                                                step_group=base + step[seq])

    groups = made.withColumn("grp", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(n_groups)))
    return groups.groupBy("grp").applyInPandas(
        pack_group, f"doc_id {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, "
                    "sequence_id bigint, offset bigint, tier int, step_group bigint")
