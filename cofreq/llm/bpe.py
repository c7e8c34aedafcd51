"""Operator 6: byte-level BPE encoding and decoding by tree concatenation.

The vocabulary is read from a ``tokenizers`` JSON file (its path is a
parameter).  A text is cut by the file's pre-tokenisation pattern into
pretokens, which BPE never merges across.  A pretoken longer than
``leaf_bytes`` is *long unsplit text*: its halves are encoded independently
(down to leaves, all leaves in one batch) and the two halves of a node are
joined by re-encoding a window around the join.  The window grows until its
first token equals the left half's token at that place and its last token
equals the right half's.  Then every adjacent pair of tokens in the result
also occurs in a true encoding, which for rank-ordered BPE makes the whole
sequence the true encoding, so the join is exact and its cost does not depend
on the length of the halves.

Defined results: null and empty texts give no token and the hashes of the
empty string; the special token's own string in a text is the special id, as
the library has it; one row out for each row in, whatever repeats."""

from __future__ import annotations

import hashlib
import json
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cofreq.llm.common import map_arrow, utf8

LEAF_BYTES = 2_048
_DOUBLE_SPACE = re.compile(r"\s\s|\s\Z")
# fixed values: the pre-tokenisation pattern of byte-level BPE vocabularies of this kind
_PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+"
PATTERN = _PIECES + r"|\s+(?!\S)|\s+"
# the same pieces for texts without a run of blanks, where the look-ahead never matters
PATTERN_SINGLE_BLANKS = _PIECES + r"|\s+"


def byte_symbols() -> dict[str, int]:
    """The printable character that stands for each byte in such vocabularies."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}


def default_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class ByteBpe:
    """Encoder and decoder of one vocabulary file."""

    def __init__(self, path: str | None = None, leaf_bytes: int = LEAF_BYTES):
        import regex
        import tiktoken

        with open(path or default_path("byte_bpe_50k.json"), encoding="utf-8") as f:
            spec = json.load(f)
        symbols = byte_symbols()
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        ranks = {bytes(symbols[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in self.special}
        make = lambda pattern: tiktoken.Encoding(
            "vocabulary", pat_str=pattern, mergeable_ranks=ranks, special_tokens=self.special)
        self.full, self.single = make(PATTERN), make(PATTERN_SINGLE_BLANKS)
        self.token = {i: t for t, i in ranks.items()}
        self.leaf_bytes = leaf_bytes
        self.long_run = re.compile(r"\S{%d,}|\s{%d,}" % (leaf_bytes, leaf_bytes))
        self.pieces = regex.compile(PATTERN)
        self.cut = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None

    def encode(self, text: str) -> list[int]:
        if self.cut is None or not self.cut.search(text):
            return self._ordinary(text)
        ids: list[int] = []
        for part in self.cut.split(text):
            ids += [self.special[part]] if part in self.special else self._ordinary(part)
        return ids

    def _ordinary(self, text: str) -> list[int]:
        if self.long_run.search(text):
            return self._with_long_pieces(text)
        if _DOUBLE_SPACE.search(text):
            return self.full.encode_ordinary(text)
        return self.single.encode_ordinary(text)

    def _with_long_pieces(self, text: str) -> list[int]:
        ids: list[int] = []
        for m in self.pieces.finditer(text):
            piece = m.group().encode("utf-8")
            ids += self.tree(piece) if len(piece) > self.leaf_bytes else self._piece(piece)
        return ids

    def _piece(self, piece: bytes) -> list[int]:
        return self.full._encode_single_piece(piece)

    def tree(self, piece: bytes) -> list[int]:
        """Encoding of one long pretoken by tree concatenation."""
        leaves = [piece[i:i + self.leaf_bytes] for i in range(0, len(piece), self.leaf_bytes)]
        level = [self._piece(x) for x in leaves]
        while len(level) > 1:
            level = [self._join(level[i], level[i + 1]) if i + 1 < len(level) else level[i]
                     for i in range(0, len(level), 2)]
        return level[0]

    def _join(self, left: list[int], right: list[int]) -> list[int]:
        k = 2
        while True:
            a, b = left[-k:], right[:k]
            window = self._piece(b"".join(map(self.token.__getitem__, a + b)))
            left_agrees = len(a) == len(left) or window[0] == a[0]
            right_agrees = len(b) == len(right) or window[-1] == b[-1]
            # one token that is both ends' would overlap itself
            apart = len(window) > 1 or (len(a) == len(left) and len(b) == len(right))
            if left_agrees and right_agrees and apart:
                return left[:len(left) - len(a)] + window + right[len(b):]
            k *= 2

    def decode(self, ids: list[int]) -> str:
        return self.full.decode_bytes(ids).decode("utf-8", "replace")


@lru_cache(maxsize=4)
def _bpe(path: str | None, leaf_bytes: int) -> ByteBpe:
    return ByteBpe(path, leaf_bytes)


def encode_documents(df: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text",
                     leaf_bytes: int = LEAF_BYTES) -> DataFrame:
    """``[doc_id, ids array<int>]`` for every row."""
    rows = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        bpe = _bpe(path, leaf_bytes)
        ids = [bpe.encode((t or b"").decode("utf-8", "replace")) for t in utf8(batch, "text")]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))],
                                          names=["doc_id", "ids"])

    return map_arrow(rows, run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, ids array<int>")


def decode_documents(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """``[doc_id, text]`` from ``[doc_id, ids]``."""
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        bpe = _bpe(path, LEAF_BYTES)
        texts = [bpe.decode(x or []) for x in batch.column("ids").to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())],
                                          names=["doc_id", "text"])

    rows = encoded.select("doc_id", "ids")
    return map_arrow(rows, run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, text string")


def round_trip(df: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text",
               leaf_bytes: int = LEAF_BYTES) -> DataFrame:
    """Encode and decode in one pass: ``[doc_id, n_tokens, ids_sha256,
    decoded_sha256]``; neither ids nor texts leave the task."""
    rows = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        bpe = _bpe(path, leaf_bytes)
        n, ids_hash, text_hash = [], [], []
        for t in utf8(batch, "text"):
            ids = bpe.encode((t or b"").decode("utf-8", "replace"))
            n.append(len(ids))
            ids_hash.append(hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
            text_hash.append(hashlib.sha256(bpe.decode(ids).encode("utf-8")).hexdigest())
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids_hash), pa.array(text_hash)],
            names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return map_arrow(rows, run, f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
