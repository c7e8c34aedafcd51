"""Operator 5: language identification by compression.

For each language a zstandard raw-content dictionary is cut from a bounded
sample of labelled texts; a text belongs to the language whose dictionary
compresses it to the fewest bytes.  The whole text is encoded, in blocks, so
that a long text does not become its own dictionary.  When the relative margin
to the second best is below ``min_margin`` the prediction is marked
``rejected`` (the best language is still named).

Before encoding, letters are lower-cased and everything else becomes one
space.  Defined results: null texts and texts without a letter get ``und``
with score 0; ties go to the first language in alphabetical order with score
0.5 / n; with no labelled text every prediction is ``und``."""

from __future__ import annotations

import re
import zlib
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cofreq.llm.common import map_arrow, row_sample, text_window, utf8

DICT_BYTES = 110_000  # of one language's dictionary
ALL_DICT_BYTES = 32 << 20  # of all of them: the broadcast bound
SAMPLE_DOCS = 1_500  # labelled texts per language that a dictionary is cut from, at most about
SAMPLE_CHARS = 4_000  # of a longer sampled text, a run of this length is used
BLOCK = 4_096  # bytes encoded at once
MIN_MARGIN = 0.01

_OTHER = re.compile(r"[\W\d_]+")


def normalise(text: str) -> bytes:
    return _OTHER.sub(" ", text.lower()).strip().encode("utf-8", "replace")


def fit_dictionaries(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                     lang_col: str = "lang") -> dict[str, bytes]:
    """Language -> raw dictionary content, from a bounded sample of the rows
    with a language and a letter, whatever their length."""
    rows = labelled.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    rows = rows.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return {}
    each = min(DICT_BYTES, ALL_DICT_BYTES // len(counts))
    target = max(8, SAMPLE_DOCS * each // DICT_BYTES)
    picked = reduce(DataFrame.unionByName, (row_sample(rows.where(F.col("lang") == F.lit(lang)), "id", n, target)
                                            for lang, n in sorted(counts.items()) if n > target), rows.where(
        F.col("lang").isin([lang for lang, n in counts.items() if n <= target])))
    # in a long text only letters count, so that its run is not all digits
    letters = F.when(F.length("text") <= SAMPLE_CHARS, F.col("text")).otherwise(
        F.regexp_replace("text", r"[^\p{L}\p{Nl}\p{No}]+", " "))
    picked = picked.select("id", "lang", letters.alias("text")).select(
        "lang", text_window(F.col("text"), F.col("id"), SAMPLE_CHARS).alias("text"))
    texts: dict[str, set[bytes]] = {}
    for r in picked.collect():  # about ``target`` texts of a language, SAMPLE_CHARS each at most
        texts.setdefault(r["lang"], set()).add(normalise(r["text"]))
    out = {}
    for lang, found in sorted(texts.items()):
        order = sorted((b for b in found if b), key=lambda b: (zlib.crc32(b), b))
        if order:
            out[lang] = b" ".join(order)[:each]
    return out


def _scorer(dicts: dict[str, bytes], level: int, min_margin: float):
    import zstandard as zstd

    langs = sorted(dicts)
    made = []
    for lang in langs:
        d = zstd.ZstdCompressionDict(dicts[lang], dict_type=zstd.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(level=level)
        made.append(zstd.ZstdCompressor(dict_data=d, level=level, write_content_size=False, write_checksum=False,
                                        write_dict_id=False).compress)

    def predict(raw: bytes | None) -> tuple[str, float, bool]:
        if raw is None or not langs:
            return "und", 0.0, True
        b = normalise(raw.decode("utf-8", "replace"))
        if not b or not any(map(str.isalpha, b.decode())):
            return "und", 0.0, True
        blocks = [b[i:i + BLOCK] for i in range(0, len(b), BLOCK)]
        sizes = [sum(len(c(x)) for x in blocks) for c in made]
        best = min(range(len(langs)), key=sizes.__getitem__)
        rest = min((s for i, s in enumerate(sizes) if i != best), default=sizes[best] * 2)
        margin = (rest - sizes[best]) / rest
        return langs[best], 0.5 / len(langs) if margin == 0 else min(1.0, 0.5 + 2 * margin), margin < min_margin

    return predict


def identify(df: DataFrame, dicts: dict[str, bytes], id_col: str = "doc_id", text_col: str = "text",
             level: int = 6, min_margin: float = MIN_MARGIN) -> DataFrame:
    """``[doc_id, lang_pred, score, rejected]`` for every row."""
    shared = df.sparkSession.sparkContext.broadcast(dicts)  # at most ALL_DICT_BYTES
    cell: list = []

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        if not cell:
            cell.append(_scorer(shared.value, level, min_margin))
        res = [cell[0](b) for b in utf8(batch, "text")]
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array([r[0] for r in res], pa.string()),
             pa.array([r[1] for r in res], pa.float64()), pa.array([r[2] for r in res], pa.bool_())],
            names=["doc_id", "lang_pred", "score", "rejected"])

    rows = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return map_arrow(rows, run, f"doc_id {kind}, lang_pred string, score double, rejected boolean")
