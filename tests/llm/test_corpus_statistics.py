"""Operators 11 to 13 against brute force on a small fixture with nulls in every
column, empty and long texts, ties, repeated rows and clashing columns."""

import hashlib
import random
import re
import string
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
CLASH = ("n", "docs", "term", "part", "key", "run", "row", "digest", "entry", "check", "phrase", "words", "f", "idx", "block",
         "value", "rank", "p", "q", "v", "total", "keep_id", "summary")
LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def rows():
    rnd = random.Random(11)
    word = lambda: "".join(rnd.choice("abc") for _ in range(rnd.randint(1, 3)))
    prose = lambda n: " ".join(rnd.choice([word(), "New York", "of the,", "city. ", "ÄÖ ü"]) for _ in range(n))
    hot = "The quick brown fox, the quick brown fox\tof the city\nNEW york city"
    texts = [None, "", " \t ", ".,;:!?", "one", "One", "ONE", "öNE", "ÖNE", "a\x0bb\x0cc\rd", "a  b\t\tc", "x" * 70_000,
             "日本語 テスト、日本語 テスト", "it's 4 o'clock_now", prose(6000)]
    texts += [hot] * 25 + [hot.upper()] * 5 + [prose(60) for _ in range(25)]
    out = [(i, t, ("en", "de", None)[i % 7 % 3], None if i % 11 == 0 else f"s{i % 4}", i) for i, t in enumerate(texts)]
    out += [out[4], out[4], out[20], (None, "one", "en", "s1", 0), (None, "nameless", "en", "lonely", 0),
            (None, "nameless", "en", "lonely", 0), (900, "1 2 3", "xx", "numbers", 0), (901, "4", "xx", "digits", 0)]
    return out


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(rows(), SCHEMA)
    return df.select("*", *(F.lit("x").alias(c) for c in CLASH)).repartition(5).cache()


def lowered(t):
    return (t or "").translate(LOWER)


# --- 11 collocations ----------------------------------------------------------


def brute_counts(data, max_words):
    f, n = Counter(), Counter()
    for _, t, lang, *_ in data:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", lowered(t)):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(w)
            for m in range(1, max_words + 1):
                for i in range(len(w) - m + 1):
                    f[lang, tuple(w[i:i + m])] += 1
    return f, n


def brute_collocations(data, threshold, max_words, absorbed, top):
    f, n = brute_counts(data, max_words)
    cand = {k: a for k, a in f.items() if a >= threshold and len(k[1]) > 1}
    found = defaultdict(list)
    for (lang, w), a in cand.items():
        inside = lambda q: any(q[i:i + len(w)] == w for i in range(len(q) - len(w) + 1))
        if any(other == lang and len(q) > len(w) and 100 * b >= absorbed * a and inside(q) for (other, q), b in cand.items()):
            continue
        score, _, left, right = min((1000 * a * n[lang] // (f[lang, w[:k]] * f[lang, w[k:]]), k, f[lang, w[:k]], f[lang, w[k:]])
                                    for k in range(1, len(w)))
        found[lang].append((-score, -a, " ".join(w).encode(), left, right))
    return sorted((lang, i + 1, p.decode(), -a, left, right, n[lang], -s) for lang, x in found.items()
                  for i, (s, a, p, left, right) in enumerate(sorted(x)[:top]))


@pytest.mark.parametrize(("threshold", "max_words", "absorbed", "top"), [(5, 5, 100, 2000), (3, 3, 80, 4), (30, 5, 100, 2000), (1, 2, 100, 50)])
def test_collocations(docs, threshold, max_words, absorbed, top):
    from cofreq.llm.collocations import top_collocations

    got = top_collocations(docs, top, threshold=threshold, max_words=max_words, absorbed=absorbed)
    got = sorted(tuple(r[c] for c in ("lang", "rank", "phrase", "a", "l", "r", "n", "score")) for r in got.collect())
    assert got == brute_collocations(rows(), threshold, max_words, absorbed, top)


def test_no_frequent_phrase_is_lost_when_counters_are_few():
    """Summaries far smaller than the number of distinct keys, merged from parts."""
    from cofreq.llm.summaries import Summary, added, pack, unpack

    rng = np.random.default_rng(5)
    for threshold in (2, 10, 100):
        often = rng.integers(0, 1 << 36, 20, dtype=np.uint64)
        stream = rng.permutation(np.concatenate([np.repeat(often, threshold), rng.integers(0, 1 << 36, 60_000, dtype=np.uint64)]))
        summary = Summary(2 * len(stream) // threshold // 8, threshold)  # too few: it must take more by itself
        summary.n_waiting = 0
        for part in np.array_split(stream, 37):
            keys, counts = added(part, np.ones(len(part), np.int64))
            again = unpack(pack(keys, counts))
            assert (again[0] == keys).all() and (again[1] == counts).all()
            summary.add(*again)
            summary.settle()
        assert summary.off <= threshold // 2
        assert np.isin(often, summary.survivors()).all()
        if threshold == 100:
            assert len(summary.keys) < 12_000  # of 60,020


def test_phrases_with_one_hash_are_told_apart():
    from cofreq.llm.collocations import Words, distinct_phrases

    words = Words([b"a b a b. c d"])
    start = np.array([0, 2, 4])
    assert sorted(distinct_phrases(words, start, np.array([7, 7, 7], np.uint64), 2)) == [(0, 1), (2, 1), (4, 1)]
    assert sorted(distinct_phrases(words, start[:2], np.array([7, 7], np.uint64), 2)) == [(0, 2)]


def test_scores_pass_64_bits(spark):
    """A product far beyond 64 bits in the exact score."""
    big = 3_000_000_000_000
    got = spark.range(1).select(F.call_function(
        "div", F.lit(1000).cast("decimal(4,0)") * F.lit(big).cast("decimal(19,0)") * F.lit(big + 1).cast("decimal(19,0)"),
        F.lit(big - 7).cast("decimal(19,0)") * F.lit(big - 9).cast("decimal(19,0)")).alias("s")).first()["s"]
    assert got == 1000 * big * (big + 1) // ((big - 7) * (big - 9))


# --- 12 exact duplicates ------------------------------------------------------


@pytest.mark.parametrize("keep", ["smallest", "largest"])
@pytest.mark.parametrize("light", [1_000, 2])
def test_exact_duplicates(docs, keep, light, monkeypatch):
    from cofreq.llm import exact_dedup

    monkeypatch.setattr(exact_dedup, "LIGHT_ROWS", light)  # with 2, larger groups are broadcast
    got = exact_dedup.exact_duplicates(docs, keep).collect()
    groups = defaultdict(list)
    for d, t, *_ in rows():
        groups[lowered(t)].append(d)
    want = Counter()
    for t, ids in groups.items():
        named = [i for i in ids if i is not None]
        best = (min if keep == "smallest" else max)(named) if named else None
        sha = hashlib.sha256(t.encode()).hexdigest()
        for d in ids:
            want[d, best, len(ids), sha] += 1
    assert Counter((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got) == want
    stays = Counter(r["text_sha256"] for r in got if r["kept"])
    assert set(stays.values()) == {1} and len(stays) == len(groups)
    assert all(r["doc_id"] == r["keep_id"] for r in got if r["kept"])


def test_many_runs_merge_to_one(spark):
    """More runs than one round merges, one text in most of them."""
    from cofreq.llm.exact_dedup import exact_duplicates, leaf_runs, merge_runs

    df = spark.range(4000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 > 0, F.lit("Same")).otherwise(
        F.concat(F.lit("t"), (F.col("id") % 600).cast("string"))).alias("text")).repartition(70)
    leaves = leaf_runs(df)
    assert leaves.agg(F.max("run")).first()[0] == 69
    assert merge_runs(leaves).count() == 201
    got = {r["doc_id"]: (r["keep_id"], r["group_size"]) for r in exact_duplicates(df).collect()}
    assert got[3998] == (1, 2666) and got[603] == (3, 7) and len(got) == 4000


# --- 13 source divergence -----------------------------------------------------


def brute_divergence(data, min_docs, top):
    count, docs, groups = defaultdict(Counter), defaultdict(Counter), set()
    for _, t, lang, source, _ in data:
        g = (lang or "", source or "")
        groups.add(g)
        terms = re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", lowered(t))
        count[g].update(terms)
        docs[g[0]].update(set(terms))
    out = []
    for lang, source in groups:
        kept = sorted(w for w, c in docs[lang].items() if c >= min_docs)
        mine = [g for g in groups if g[0] == lang]

        def shares(c, kept=kept):
            total = sum(c[w] for w in kept)
            return {w: 1 + 1_000_000_000 * (c[w] + 1) // (total + len(kept)) for w in kept}

        p = shares(count[lang, source])
        f = lambda a, b: (a - b) ** 2 // b
        pairs = []
        for _, other in mine:
            if other != source:
                q = shares(count[lang, other])
                pairs.append((-sum(f(p[w], q[w]) for w in kept), other.encode()))
        q = shares(sum((count[g] for g in mine), Counter()))
        terms = [(-f(p[w], q[w]), w.encode()) for w in kept if count[lang, source][w] and p[w] > q[w]]
        for part, found in (("pair", sorted(pairs)), ("term", sorted(terms)[:top])):
            out += [(lang, source, part, item.decode(), -v, i + 1) for i, (v, item) in enumerate(found)]
    return sorted(out)


@pytest.mark.parametrize(("chunk", "block", "min_docs", "top", "held"), [
    (4096, 256, 3, 200, 200_000), (7, 2, 3, 5, 50), (5, 1, 2, 200, 1), (4096, 3, 1000, 200, 200_000)])
def test_divergences(docs, chunk, block, min_docs, top, held, monkeypatch):
    from cofreq.llm import source_audit

    monkeypatch.setattr(source_audit, "CHUNK_TERMS", chunk)
    monkeypatch.setattr(source_audit, "BLOCK_SOURCES", block)
    monkeypatch.setattr(source_audit, "HELD", held)
    got = source_audit.divergences(docs, min_docs, top)
    got = sorted(tuple(r[c] for c in ("lang", "source", "part", "item", "value", "rank")) for r in got.collect())
    assert got == brute_divergence(rows(), min_docs, top)


def test_empty_tables(docs):
    from cofreq.llm.collocations import top_collocations
    from cofreq.llm.exact_dedup import exact_duplicates
    from cofreq.llm.source_audit import divergences

    none = docs.where(F.lit(False))
    for result in (top_collocations(none), exact_duplicates(none), divergences(none)):
        assert result.collect() == []
