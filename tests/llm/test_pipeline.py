"""The pipeline against brute force, stage by stage, over a whole small table."""

import os
import re
import sys
from collections import Counter

import numpy as np

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from test_operators import SF, brute_join, brute_spans  # noqa: E402


def without_repeats(rows, width=200):
    data = {d: t.encode() for d, t in rows}
    count = Counter(x[i:i + width] for x in data.values() for i in range(len(x) - width + 1))
    out = {}
    for d, x in data.items():
        gone = np.zeros(len(x), bool)
        for i in range(len(x) - width + 1):
            if count[x[i:i + width]] > 1:
                gone[i:i + width] = True
        rest = bytes(b for b, g in zip(x, gone) if not g).decode("utf-8", "ignore")
        if re.search(r"\S", rest):
            out[d] = rest
    return out


def redacted(text):
    out, at = [], 0
    spans = [s.split(":") for s in brute_spans(text).split(",") if s]
    for kind, a, b in spans:
        if int(a) >= at:
            out += [text[at:int(a)], f"[{kind.upper()}]"]
            at = int(b)
        else:  # overlaps the span before it
            at = max(at, int(b))
    return "".join([*out, text[at:]])


def test_pipeline_stages(spark):
    import corpus_pipeline as pipeline
    from cofreq.llm.common import stage
    from cofreq.llm.line_crf import fit_from_labels, judge

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    steps = dict(pipeline.STAGES)
    rows = lambda d: sorted((r["doc_id"], r["text"]) for r in d.collect())

    verdict = judge(docs, fit_from_labels(docs, spark.read.parquet(f"{SF}/labels.parquet")))
    kept = {r["doc_id"] for r in verdict.where("kept").collect()}
    good = stage(steps["quality"](spark, docs, SF), "test")
    assert good.columns == columns and rows(good) == [r for r in rows(docs) if r[0] in kept]

    single = stage(steps["near_duplicates"](spark, good, SF), "test")
    first = {d for d, _, c in brute_join(rows(good), 5, 80, 100) if d == c}
    assert single.columns == columns and rows(single) == [r for r in rows(good) if r[0] in first]

    rest = stage(steps["repeated_passages"](spark, single, SF), "test")
    assert rest.columns == columns and dict(rows(rest)) == without_repeats(rows(single))

    clean = stage(steps["personal_data"](spark, rest, SF), "test")
    assert clean.columns == columns and rows(clean) == [(d, redacted(t)) for d, t in rows(rest)]
    assert clean.where("n_chars != length(text)").count() == 0

    packed = steps["packing"](spark, clean, SF).collect()
    assert {r["doc_id"] for r in packed} == {d for d, _ in rows(clean)}
    for d in {r["doc_id"] for r in packed}:
        own = [r for r in packed if r["doc_id"] == d]
        assert sum(r["length"] for r in own) == own[0]["doc_tokens"]
