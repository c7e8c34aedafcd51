"""Operator 1: quality rules by line sequence labelling.

The lines of a document form a linear chain; a conditional random field with
two labels (content, boilerplate) scores every line by features of its bytes
and words, and neighbouring labels by a transition matrix.  Viterbi decoding
labels the lines, and the share of words on content lines decides whether the
document is kept.

The field is fitted on a bounded sample of documents with a quality label:
every non-blank line of a good document is content, of a bad one boilerplate.
Fitting is maximum likelihood by gradient ascent on the forward-backward
marginals, on the driver, over at most ``SAMPLE_DOCS`` texts.

Defined results: null and empty texts have no words, fail the base rules and
are not kept; repeated rows are judged one by one; blank lines are skipped in
the chain; with no usable label every line counts as content."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cofreq.llm.common import map_arrow, row_sample, stage, text_window, utf8

SAMPLE_DOCS = 2_000  # labelled documents the field is fitted on, at most about
SAMPLE_CHARS = 8_000  # of a longer sampled text, a run of lines of about this length is used
MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW = 20, 30, 8
CONTENT_SHARE = 0.5
_BLANKS, _SYMBOLS = b" \t\n\x0b\x0c\r", b"#*$%&|<>"


def _class(members: bytes) -> np.ndarray:
    out = np.zeros(256, np.float32)
    out[list(members)] = 1
    return out


_BLANK = _class(_BLANKS)
# byte classes whose share of a line's bytes is a feature
_CLASSES = np.stack([
    _class(_SYMBOLS), _class(b"!?"), _class(b".,;:"), _class(b"0123456789"), _class(bytes(range(65, 91))),
    _class(bytes(range(97, 123))), _class(b"=\"'/\\@_+()[]{}~^`-"), _class(bytes(range(128, 256)))])

N_FEATURES = 1 + len(_CLASSES) + 4 + 8 + 2


def repeated_words(words: list[bytes]) -> int:
    """Words in 8-word windows that occur at least twice, first ones included
    (exact: windows are compared by ranks, doubled three times)."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    codes: dict[bytes, int] = {}
    rank = np.fromiter((codes.setdefault(w, len(codes)) for w in words), np.int64, len(words))
    if len(codes) == len(words):
        return 0
    step = 1
    while step < WINDOW:
        pair = rank[:-step] * (int(rank.max()) + 1) + rank[step:]
        rank = np.unique(pair, return_inverse=True)[1]
        step *= 2
    again = np.bincount(rank)[rank] > 1
    if not again.any():
        return 0
    edge = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(again)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + WINDOW, -1)
    return int((np.cumsum(edge)[:-1] > 0).sum())


def base_rules(text: bytes) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    words = text.split()
    solid = text.translate(None, _BLANKS)
    tails = 0 if solid.isascii() else int(((np.frombuffer(solid, np.uint8) & 0xC0) == 0x80).sum())
    lines = [x for x in text.split(b"\n") if x.strip(_BLANKS)]
    return (len(words), len(solid) - tails, len(text) - len(text.translate(None, _SYMBOLS)),
            len(lines) - len(set(lines)), repeated_words(words))


def line_features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features, words per line, lines per text) of the non-blank lines."""
    if not texts:
        return np.zeros((0, N_FEATURES)), np.zeros(0, int), np.zeros(0, int)
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    blank = _BLANK[data] > 0
    starts_word = ~blank
    starts_word[1:] &= blank[:-1]
    ends = np.flatnonzero(data == 10) + 1
    begins = np.concatenate([[0], ends[:-1]])
    add = lambda x: np.add.reduceat(x, begins)
    n_words = add(starts_word.astype(np.int32))
    real = n_words > 0
    solid = np.maximum(add((~blank).astype(np.int32)), 1).astype(np.float64)
    shares = [add(c[data]) / solid for c in _CLASSES]
    newline_count = np.array([t.count(b"\n") + 1 for t in texts])
    owner = np.repeat(np.arange(len(texts)), newline_count)[real]
    n_lines = np.bincount(owner, minlength=len(texts))
    # words that repeat the word before them, by their first and last bytes and length
    w_at = np.flatnonzero(starts_word)
    w_end = np.flatnonzero(blank & np.concatenate([[False], ~blank[:-1]]))
    key = (w_end - w_at) * 65536 + data[w_at].astype(np.int64) * 256 + data[w_end - 1]
    same = np.zeros(len(data), np.float32)
    if len(key) > 1:
        same[w_at[1:]] = key[1:] == key[:-1]
    words = np.maximum(n_words, 1)
    cols = [*shares, add(same) / words, np.log1p(n_words), solid / words / 10, np.minimum(n_words, 3) == 1]
    x = np.stack([np.asarray(c, float)[real] for c in cols], axis=1)
    first = np.concatenate([[0], np.cumsum(n_lines)])[:-1][n_lines > 0]
    edge = np.zeros((len(x), 2))
    if len(x):
        edge[first, 0] = 1
        edge[np.concatenate([first[1:], [len(x)]]) - 1, 1] = 1
    sharp = np.minimum(x[:, :8] * 10, 1)  # is there any
    return np.hstack([np.ones((len(x), 1)), x, sharp, edge]), n_words[real], n_lines


def _by_position(n_lines: np.ndarray):
    """For each position in the chains: (texts that have it, their rows)."""
    first = np.concatenate([[0], np.cumsum(n_lines)])[:-1]
    order = np.argsort(-n_lines, kind="stable")
    counts = n_lines[order]
    for t in range(int(n_lines.max(initial=0))):
        live = order[:np.searchsorted(-counts, -t, side="left")]
        yield live, first[live] + t


def viterbi(score: np.ndarray, trans: np.ndarray, n_lines: np.ndarray) -> np.ndarray:
    """Best labels of all chains at once; ``score`` is [lines, 2].  Ties go to
    label 1 (content)."""
    best = np.zeros((len(n_lines), 2))
    back = np.zeros(score.shape, np.int8)
    steps = list(_by_position(n_lines))
    for t, (live, rows) in enumerate(steps):
        if t == 0:
            best[live] = score[rows]
            continue
        come = best[live][:, :, None] + trans
        back[rows] = come[:, 1] >= come[:, 0]
        best[live] = come.max(axis=1) + score[rows]
    labels = np.zeros(len(score), np.int8)
    state = (best[:, 1] >= best[:, 0]).astype(np.int8)
    for live, rows in reversed(steps):
        labels[rows] = state[live]
        state[live] = back[rows, state[live]]
    return labels


def _marginals(score: np.ndarray, trans: np.ndarray, n_lines: np.ndarray):
    """Label marginals of the lines and expected transitions (forward-backward)."""
    steps = list(_by_position(n_lines))
    alpha = np.zeros_like(score)
    for t, (live, rows) in enumerate(steps):
        alpha[rows] = score[rows] + (np.logaddexp.reduce(alpha[rows - 1][:, :, None] + trans, axis=1) if t else 0)
    beta, after = np.zeros_like(score), np.zeros((2, 2))
    for t in range(len(steps) - 1, 0, -1):
        live, rows = steps[t]
        beta[rows - 1] = np.logaddexp.reduce(trans[None] + (score[rows] + beta[rows])[:, None, :], axis=2)
    total = np.logaddexp.reduce(alpha + beta, axis=1)
    for live, rows in steps[1:]:
        after += np.exp(alpha[rows - 1][:, :, None] + trans + (score[rows] + beta[rows])[:, None, :]
                        - total[rows][:, None, None]).sum(axis=0)
    return np.exp(alpha + beta - total[:, None]), after


def fit(texts: list[bytes], good: list[bool], rounds: int = 150, rate: float = 0.1) -> tuple[np.ndarray, np.ndarray]:
    """(line weights [features, 2], transitions [2, 2])."""
    x, _, n_lines = line_features(texts)
    w, trans = np.zeros((x.shape[1], 2)), np.zeros((2, 2))
    if not len(x) or len(set(good)) < 2:
        w[0] = (-1, 1)
        return w, trans
    y = np.repeat(np.array(good, int), n_lines)
    truth = np.eye(2)[y]
    chains = np.bincount(np.array(good, int), np.maximum(n_lines - 1, 0), 2)
    weight = 1 / np.bincount(y, minlength=2)[y]  # both labels count alike
    m = [np.zeros_like(w), np.zeros_like(w), np.zeros((2, 2)), np.zeros((2, 2))]
    for i in range(1, rounds + 1):
        p, pairs = _marginals(x @ w, trans, n_lines)
        grads = (x.T @ ((truth - p) * weight[:, None]) - 1e-3 * w,
                 (np.diag(chains) - pairs) / max(1, chains.sum()) - 1e-2 * trans)
        for k, (v, g) in enumerate(((w, grads[0]), (trans, grads[1]))):
            m[2 * k] = 0.9 * m[2 * k] + 0.1 * g
            m[2 * k + 1] = 0.999 * m[2 * k + 1] + 0.001 * g * g
            v += rate * (m[2 * k] / (1 - 0.9 ** i)) / (np.sqrt(m[2 * k + 1] / (1 - 0.999 ** i)) + 1e-8)
    return w, trans


def fit_from_labels(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id",
                    text_col: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """Fit on a bounded sample of the labelled documents, whatever their length."""
    marks = labels.select(F.col("doc_id").alias("id"), F.col("quality").alias("quality")).where(
        F.col("id").isNotNull() & F.col("quality").isin(0, 1)).dropDuplicates(["id"])
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(F.col("text").rlike(r"\S"))
    marks = stage(marks.join(texts.select("id"), "id", "left_semi"), "labels")
    counts = {r["quality"]: r["n"] for r in marks.groupBy("quality").agg(F.count(F.lit(1)).alias("n")).collect()}
    picked = None
    for q, n in sorted(counts.items()):  # as many good as bad ones
        part = row_sample(marks.where(F.col("quality") == q), "id", n, SAMPLE_DOCS // 2)
        picked = part if picked is None else picked.unionByName(part)
    if picked is None:
        return fit([], [])
    # of a long text a run of lines: the cut first and last line go if others are left
    some = text_window(F.col("text"), F.col("id"), SAMPLE_CHARS)
    whole = F.regexp_extract(some, r"(?s)\A[^\n]*+\n(.*)\n[^\n]*\Z", 1)
    cut = F.when((F.length("text") <= SAMPLE_CHARS) | ~whole.rlike(r"\S"), some).otherwise(whole)
    found = texts.join(F.broadcast(picked), "id").select("id", "quality", cut.alias("text"))  # about SAMPLE_DOCS ids
    rows = sorted({(r["id"], r["quality"], r["text"]) for r in found.collect()})
    return fit([r[2].encode("utf-8", "replace") for r in rows], [r[1] == 1 for r in rows])


def _verdicts(texts: list[bytes], model: tuple[np.ndarray, np.ndarray], min_share: float):
    """(base values, base failed, kept, content share) of each text."""
    w, trans = model
    base = [base_rules(t) for t in texts]
    x, n_words, n_lines = line_features(texts)
    content = viterbi(x @ w, trans, n_lines)
    owner = np.repeat(np.arange(len(texts)), n_lines)
    on_content = np.bincount(owner, n_words * content, len(texts))
    share = on_content / np.maximum(np.bincount(owner, n_words, len(texts)), 1)
    failed = [b[0] < MIN_WORDS or 100 * b[4] > MAX_REPEAT_PERCENT * b[0] for b in base]
    return base, failed, [not f and s >= min_share for f, s in zip(failed, share)], share


def keep_good(df: DataFrame, model: tuple[np.ndarray, np.ndarray], text_col: str = "text",
              min_share: float = CONTENT_SHARE) -> DataFrame:
    """The rows of ``df`` that are kept, with all their columns."""
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        _, _, kept, _ = _verdicts([t or b"" for t in utf8(batch, text_col)], model, min_share)
        return batch.filter(pa.array(kept, pa.bool_()))

    return map_arrow(df, run, df.schema)


def judge(df: DataFrame, model: tuple[np.ndarray, np.ndarray], id_col: str = "doc_id", text_col: str = "text",
          min_share: float = CONTENT_SHARE) -> DataFrame:
    """``[doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, kept, content_share]`` for every row."""
    rows = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        base, failed, kept, share = _verdicts([t or b"" for t in utf8(batch, "text")], model, min_share)
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), *(pa.array([b[i] for b in base], pa.int64()) for i in range(5)),
             pa.array(failed, pa.bool_()), pa.array(kept, pa.bool_()), pa.array(share, pa.float64())],
            names=["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
                   "kept", "content_share"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return map_arrow(rows, run, f"doc_id {kind}, n_words bigint, word_chars bigint, n_symbols bigint, "
                                "n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean, "
                                "content_share double")
