"""Each operator against a brute-force form on a small fixture that holds the
awkward cases: nulls in every column, empty and long texts, ties, repeated rows
and columns whose names clash with the operators' own."""

import hashlib
import itertools
import os
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
CLASH = ("n", "fp", "key", "label", "seed", "size", "shard", "slot", "at", "spans", "start", "length", "grp", "item",
         "base", "more", "keys", "component_id", "kept", "score", "id", "th", "vec", "rank")


def texts():
    rnd = random.Random(4)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(1, 7)))
    prose = lambda n: " ".join(word() for _ in range(n))
    one, passage = prose(120), prose(60)
    near = one.split()
    near[50] = "changed"
    out = [None, "", " \n\t ", "one", "one two", "Two Words", "two words", one, one, " ".join(near), one.upper(),
           prose(40) + "\n" + passage + "\n" + prose(40), prose(30) + "\n" + passage, passage + " " + prose(9),
           "a b c d e f g h i " * 12, "x" * 9000, "é" * 700 + " ü" * 90, prose(6000), "ab" * 300, "ba" * 300,
           "mail joe.x@mail.example.com or +1 (234) 555-6789, 10.0.0.1 300.1.1.1 4111 1111 1111 1111 !",
           "4111-1111-1111-1112 a@b.c%d@e.f 1.2.3.4.5 +12", "<|endoftext|> in a text", "日本語 テスト 漢字", "#### $$$ %%% &&&"]
    # one text held by a third of all rows
    return out + [passage] * 14 + [prose(25) for _ in range(4)]


def documents(spark, rows=None):
    rows = texts() if rows is None else rows
    data = [(i, t, "en" if i % 3 else None, None if i % 5 == 0 else "s", i) for i, t in enumerate(rows)]
    if len(rows) > 7:
        data += [data[7], data[7]]  # repeated rows
    return spark.createDataFrame(data, SCHEMA)


def clashing(df):
    return df.select("*", *(F.lit("x").alias(c) for c in CLASH if c not in df.columns))


@pytest.fixture(scope="module")
def docs(spark):
    return clashing(documents(spark)).repartition(3).cache()


@pytest.fixture(scope="module")
def plain(docs):
    return [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]


def by_id(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


# --- 1 quality rules ----------------------------------------------------------


def test_base_rules(plain):
    from cofreq.llm.line_crf import base_rules

    for _, t in plain + [(0, "q\nq\n q\n\nq"), (0, "x\x0by\x85z"), (0, "a b c d e f g h a b c d e f g h")]:
        w = words(t)
        wins = [tuple(w[i:i + 8]) for i in range(len(w) - 7)]
        count = Counter(wins)
        covered = {i + k for i, x in enumerate(wins) if count[x] > 1 for k in range(8)}
        lines = [x for x in (t or "").split("\n") if words(x)]
        assert base_rules((t or "").encode()) == (
            len(w), sum(map(len, w)), sum((t or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered))


def test_viterbi_is_the_best_path():
    from cofreq.llm.line_crf import viterbi

    rng = np.random.default_rng(3)
    n_lines = np.array([3, 0, 6, 1, 2])
    score, trans = rng.standard_normal((12, 2)), rng.standard_normal((2, 2))
    got, at = viterbi(score, trans, n_lines), 0
    for n in n_lines:
        paths = itertools.product((0, 1), repeat=n)
        best = max(paths, key=lambda p: sum(score[at + i, y] for i, y in enumerate(p))
                   + sum(trans[a, b] for a, b in zip(p, p[1:])))
        assert tuple(got[at:at + n]) == best
        at += n


def test_quality_verdicts(spark, docs):
    from cofreq.llm.line_crf import fit_from_labels, judge, keep_good

    real, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    model = fit_from_labels(real, labels)
    got = judge(real, model).join(labels, "doc_id").where(~F.col("base_failed")).collect()
    assert np.mean([r["kept"] == (r["quality"] == 1) for r in got]) >= 0.97
    own = judge(docs, model).collect()
    assert len(own) == docs.count()
    assert all(not r["kept"] for r in own if r["n_words"] < 20)
    assert keep_good(docs, model).columns == docs.columns
    assert keep_good(docs, model).count() == sum(r["kept"] for r in own)
    unfitted = fit_from_labels(real, labels.where(F.lit(False)))  # no labels: base rules alone
    assert all(r["kept"] != r["base_failed"] for r in judge(docs, unfitted).collect())


# --- 2 repeated strings -------------------------------------------------------


def brute_repeats(rows, width):
    data = [(t or "").encode() for _, t in rows]
    count = Counter(x[i:i + width] for x in data for i in range(len(x) - width + 1))
    out = []
    for (d, _), x in zip(rows, data):
        gone = np.zeros(len(x), bool)
        for i in range(len(x) - width + 1):
            if count[x[i:i + width]] > 1:
                gone[i:i + width] = True
        rest = bytes(b for b, g in zip(x, gone) if not g)
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((d, len(x), int(gone.sum()), runs, hashlib.sha256(rest).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize(("width", "hot"), [(200, 20_000), (200, 1), (64, 20_000)])
def test_repeated_strings(docs, plain, width, hot):
    from cofreq.llm.repeats import digest, repeated_spans

    got = by_id(digest(docs, repeated_spans(docs, width, hot)), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert got == brute_repeats(plain, width)


def test_repeat_groups_have_all_occurrences():
    from cofreq.llm.repeats import SeedIndex, choosing

    rnd = random.Random(3)
    core = b""
    while not core or not choosing(b"L" * 10 + core, 10, 80):  # the anchor of its window
        core = bytes(rnd.choice(b"pqrstuv") for _ in range(70))
    # five occurrences: three agree from 40 bytes before on, all five from 10 before;
    # the three differ from each other on the right just where all five do
    left = [(b"L" * 10 + x)[:60] for x in (b"a" * 30 + b"1", b"a" * 30 + b"2", b"a" * 30 + b"3", b"b" * 9, b"c" * 9)]
    right = [core + x for x in (b"1", b"2", b"3", b"4", b"5")]
    index = SeedIndex(left, right, 80)
    assert {(a, b, frozenset(m.tolist())) for a, b, m in index.groups()} == {
        (10, 70, frozenset(range(5))), (40, 70, frozenset(range(3)))}
    to_left, to_right = index.reach()
    assert to_left.tolist() == [40, 40, 40, 10, 10] and to_right.tolist() == [70] * 5
    # where two go on together to the right, no second group has the shorter right part and those two alone
    right[:2] = [core + b"RRRRR1", core + b"RRRRR2"]
    assert {(a, b, frozenset(m.tolist())) for a, b, m in SeedIndex(left, right, 80).groups()} == {
        (10, 70, frozenset(range(5))), (40, 70, frozenset(range(3))), (40, 75, frozenset(range(2)))}


def brute_groups(texts, width):
    """The maximal repeats by definition: {string: places}."""
    where = {}
    for d, x in enumerate(texts):
        for i in range(len(x) - width + 1):
            where.setdefault(x[i:i + width], set()).add((d, i))
    out = {}
    for string, places in where.items():
        if len(places) < 2:
            continue
        size, at = len(string), sorted(places)
        same = lambda k: len({texts[d][i + k] if 0 <= i + k < len(texts[d]) else (d, i) for d, i in at}) == 1  # noqa: B023, E731
        while same(size):
            size += 1
        while same(-1):
            at, size = [(d, i - 1) for d, i in at], size + 1
        out[texts[at[0][0]][at[0][1]:at[0][1] + size]] = set(at)
    return out


@pytest.mark.parametrize("hot", [20_000, 2])
def test_maximal_groups(spark, hot):
    from cofreq.llm.repeats import maximal_groups

    rnd = random.Random(8)
    prose = lambda n: "".join(rnd.choice("abcdefgh ") for _ in range(n))
    p, q, r = prose(300), prose(1200), prose(230)
    rows = [prose(90) + p + prose(50), p + prose(70) + q, prose(20) + q + prose(99) + r, r + "é" + prose(300), prose(400),
            prose(30) + p + "!" + prose(80) + q[200:700], q[900:] + r[:215], None, "", prose(40) + p + "!" + prose(7)]
    texts = [(t or "").encode() for t in rows]
    df = clashing(spark.createDataFrame([(i, t, None, None, 0) for i, t in enumerate(rows)], SCHEMA))
    got = {}
    for x in maximal_groups(df, hot=hot).collect():
        got.setdefault(x["repeat"], (x["n"], x["length"], set()))[2].add((x["doc_id"], x["start"]))
    assert all(n == len(at) for n, _, at in got.values())
    found = {}
    for _, length, at in got.values():
        strings = {texts[d][i:i + length] for d, i in at}
        assert len(strings) == 1
        found[strings.pop()] = at
    want = brute_groups(texts, 200)
    if hot > 2:
        # a long repeat around a commoner middle part is listed as the parts beside it
        beside = {s for s in want if s not in found}
        assert beside <= {q.encode()} and all(found[s] == want[s] for s in want if s not in beside)
        parts = {s: at for s, at in found.items() if s not in want}
        assert all(s in q.encode() and len(at) == 2 for s, at in parts.items())
    # whatever the seeds, the groups cover the repeated bytes and list every occurrence
    for s, at in found.items():
        assert at == {(d, i) for d, x in enumerate(texts) for i in range(len(x)) if x.startswith(s, i)}
    cover = lambda groups: {(d, k) for s, at in groups.items() for d, i in at for k in range(i, i + len(s))}
    assert cover(found) == cover(want)


def test_maximal_groups_of_awkward_rows(docs, spark):
    from cofreq.llm.repeats import maximal_groups

    groups = maximal_groups(docs)
    assert groups.where("n < 2 or length < 200").count() == 0
    assert maximal_groups(documents(spark, [])).count() == 0
    rows = [(None, "a b c d e f g h " * 30, None, None, None), (3, "a b c d e f g h " * 30, None, None, None)]
    ids = {x["doc_id"] for x in maximal_groups(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert ids == {None, 3}


def test_strip_keeps_columns(docs):
    from cofreq.llm.repeats import repeated_spans, strip

    out = strip(docs, repeated_spans(docs))
    assert out.columns == docs.columns and out.count() == docs.count()


# --- 3 n-gram join ------------------------------------------------------------


def brute_join(rows, n, num, den):
    sets = []
    for _, t in rows:
        w = words(re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
        sets.append(frozenset(tuple(w[i:i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else
                    frozenset([tuple(w)] if w else []))
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in itertools.combinations(range(len(rows)), 2):
        both = len(sets[i] & sets[j])
        if sets[i] and sets[j] and den * both >= num * (len(sets[i]) + len(sets[j]) - both):
            root[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        low[find(i)] = min(low.get(find(i), d), d)
    return sorted((d, len(sets[i]), low[find(i)]) for i, (d, _) in enumerate(rows))


@pytest.mark.parametrize(("n", "num", "den"), [(3, 90, 100), (5, 80, 100)])
def test_ngram_join(docs, plain, n, num, den):
    from cofreq.llm.jaccard_join import jaccard_components

    got = by_id(jaccard_components(docs, n, num, den), "doc_id", "n_shingles", "component_id")
    assert got == brute_join(plain, n, num, den)


def test_linked_sets_share_a_key():
    """The guarantee behind the index: two shared prefix n-grams."""
    from cofreq.llm.jaccard_join import COMBINED, prefix_grams

    rng = np.random.default_rng(1)
    often = lambda g: g % np.uint64(3) > 0
    for num, den in ((9, 10), (8, 10)):
        edge = COMBINED * den // (den - num)
        for size in (10, 25, 200, edge - 40, edge, edge + 60, edge * den // num):
            for _ in range(12):
                a = np.unique(rng.integers(0, 1 << 63, size, dtype=np.uint64))
                cut = rng.integers(0, size * (den - num) // den + 1)
                grow = rng.integers(0, 3)
                b = np.unique(np.concatenate([rng.permutation(a)[cut:], rng.integers(0, 1 << 63, grow, dtype=np.uint64)]))
                both = len(np.intersect1d(a, b))
                if den * both >= num * (len(a) + len(b) - both):
                    if len(a) != len(b) or (a != b).any():
                        assert len(np.intersect1d(prefix_grams(a, often(a), num, den), prefix_grams(b, often(b), num, den))) >= 2


def test_hot_passage_and_near_copies(spark):
    """A group of near copies and a passage in unrelated documents."""
    from cofreq.llm.jaccard_join import jaccard_components, keep_first

    rnd = random.Random(9)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(6))
    body, passage = [word() for _ in range(150)], " ".join(word() for _ in range(60))
    rows = []
    for i in range(60):
        w = list(body)
        w[rnd.randrange(150)] = word()
        rows.append(" ".join(w))
    rows += [passage + " " + " ".join(word() for _ in range(70)) for _ in range(60)]
    d = documents(spark, rows).repartition(4)
    got = {r["doc_id"]: r["component_id"] for r in jaccard_components(d, 3, 80, 100).collect()}
    assert all(got[i] == 0 for i in range(60)) and all(got[i] == i for i in range(60, 120))
    assert sorted(r["doc_id"] for r in keep_first(d, 3, 80, 100).collect()) == [0, *range(60, 120)]


def test_combinations_without_room_are_not_made(spark):
    """Under hot n-grams only the combinations that can be the first of a link."""
    from cofreq.llm.jaccard_join import _words, frequent_keys

    # 40 sets of 145, 5 or 20 n-grams of their own before the 10 or more shared ones
    often = [(key, pos, c, 145, c) for c in range(40) for pos, key in enumerate(range(31)) if pos >= (5 if c % 2 else 20)]
    often = spark.createDataFrame(often, "key bigint, pos int, c bigint, n bigint, label bigint")
    one = spark.createDataFrame([(c, *[0] * len(_words())) for c in range(40)], "c bigint, " + ", ".join(f"{w} bigint" for w in _words()))
    made = frequent_keys(often, one, 80, 100)
    # two of 145 need 129 in common: the second may be the 18th at most
    assert {r["c"] for r in made.select("c").distinct().collect()} == set(range(1, 40, 2))
    assert made.count() == 20 * 13 * 12 // 2
    assert all(len(r["own"]) == 26 for r in made.select("own").collect())


def test_near_copies_around_the_threshold(spark):
    from cofreq.llm.jaccard_join import jaccard_components

    rnd = random.Random(4)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(6))
    body, passage = [word() for _ in range(149)], [word() for _ in range(60)]
    rows = []
    for i in range(90):
        w = list(body[:149 - 4 * (i % 3)])
        for _ in range(i % 6):
            w[rnd.choice([rnd.randrange(len(w)), 7, 70])] = word()
        rows.append(" ".join(w))
    rows += [" ".join(passage + [word() for _ in range(i % 40)]) for i in range(60)]
    d = documents(spark, rows).repartition(4)
    for n, num, den in ((5, 80, 100), (3, 90, 100)):
        got = by_id(jaccard_components(d, n, num, den).distinct(), "doc_id", "n_shingles", "component_id")
        assert got == brute_join(list(enumerate(rows)), n, num, den)


def test_components_of_a_chain(spark):
    from cofreq.llm.components import components

    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(90, 91), (91, 90), (5, 5), (None, 3)], "a int, b int")
    assert dict(by_id(components(links), "node", "label")) == {**{i: 0 for i in range(41)}, 90: 90, 91: 90}


# --- 4 packing ----------------------------------------------------------------


def test_packing(docs, plain):
    import public_tokenizers
    from tokenizers import Tokenizer

    from cofreq.llm.packing import pack

    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    library.no_truncation()
    library.no_padding()
    rows = pack(docs, group_pieces=25).collect()
    pieces = Counter()
    for d, t in plain:
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        for s in range(0, len(ids), 4096):
            part = ids[s:s + 4096]
            pieces[d, s, len(part), zlib.crc32(part.tobytes()), len(ids)] += 1
    assert Counter((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in rows) == pieces
    sequences = {}
    for r in rows:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"], r["tier"]))
    for parts in sequences.values():
        at = 0
        for offset, length, tier in sorted(parts):
            assert offset == at
            at += length
        assert at <= tier <= 4096


def test_packing_wastes_little():
    from cofreq.llm.packing import TIERS, pack_lengths

    rng = np.random.default_rng(2)
    lengths = np.minimum(4096, rng.lognormal(6.4, 1.0, 20_000).astype(int) + 1)
    seq, _ = pack_lengths(lengths)
    total = np.bincount(seq, lengths).astype(int)
    waste = sum(4096 - x for x in total if x & (x - 1))
    assert total.max() <= 4096 and waste < 0.01 * lengths.sum()
    assert set(TIERS[:-1]) <= set(total.tolist())  # the shorter tiers are used
    assert len(pack_lengths(np.zeros(0, int))[0]) == 0


def test_word_ids_equal_the_library():
    import public_tokenizers
    import pyarrow as pa
    from tokenizers import Tokenizer

    from cofreq.llm.packing import WordBpe

    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    w = WordBpe()
    odd = ["a\x01b c\x02", "don't WE'LL", "ǅa Σας ΣΣ", "naïve É́ é", "<|endoftext|>x <|EndOfText|>", "1234 ¼ ² ٣",
           "a b\x85c", "日本語 テスト", "İstanbul ß ẞ × ÷ª", "__x__ _ -", "\x1c\x1d x\x1fy", "", "  ", "a‍b", None]
    ids, ends = w.encode(pa.array(odd))
    for i, t in enumerate(odd):
        assert ids[ends[i]:ends[i + 1]].tolist() == library.encode(t or "", add_special_tokens=False).ids, t


# --- 5 language ---------------------------------------------------------------


def test_language_held_out(spark):
    from cofreq.llm.queries import op5_language_id

    got = op5_language_id(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet"), "doc_id").where("held_out").collect()
    assert len(got) > 30 and np.mean([r["lang"] == r["lang_pred"] for r in got]) >= 0.95


def test_language_cases(spark, docs):
    from cofreq.llm.langid import fit_dictionaries, identify

    dicts = fit_dictionaries(docs.where(F.col("doc_id") > 10))
    assert set(dicts) == {"en"}
    got = identify(docs, dicts).collect()
    assert len(got) == docs.count() and all(0 <= r["score"] <= 1 for r in got)
    und = {r["doc_id"] for r in got if r["lang_pred"] == "und"}
    assert und == {r["doc_id"] for r in docs.collect() if not any(map(str.isalpha, r["text"] or ""))}
    assert {r["lang_pred"] for r in identify(docs, {}).collect()} == {"und"}
    long = "the and of with this from that " * 9
    both = identify(documents(spark, [long]), {"aa": b"the and of with this from that", "bb": b"zu der die"})
    assert {r["lang_pred"] for r in both.collect()} == {"aa"}


def test_languages_of_long_texts(spark):
    from cofreq.llm.langid import DICT_BYTES, SAMPLE_CHARS, fit_dictionaries, identify

    en, de = "the house of the old man and his dog is on the hill ", "das haus des alten mannes und sein hund auf dem berg "
    rows = [(i, en * 200 + str(i), "en", "s", 0) for i in range(20)] + [(20 + i, de + str(i), "de", "s", 0) for i in range(20)]
    rows.append((40, "1234567890" * 3000 + " " + "bonjour la maison", "fr", "s", 0))
    rows += [(41 + i, "12 34", "it", "s", 0) for i in range(9)]
    frame = spark.createDataFrame(rows, SCHEMA)
    dicts = fit_dictionaries(frame)
    assert set(dicts) == {"en", "de", "fr"} and all(0 < len(d) <= DICT_BYTES for d in dicts.values())
    assert len(dicts["en"]) <= 20 * (SAMPLE_CHARS + 1)
    got = {r["doc_id"]: r["lang_pred"] for r in identify(frame, dicts).collect()}
    assert {got[i] for i in range(20)} == {"en"} and {got[i] for i in range(20, 40)} == {"de"}


def test_quality_of_long_texts(spark):
    from cofreq.llm.line_crf import SAMPLE_CHARS, fit_from_labels, judge

    good, junk = "The old man walked along the river and thought of his house.", "$$$ >>> 4711 ### buy!!! 99% @@ 0815 |||"
    body = lambda line, i, n: "\n".join(f"{line} {j * 31 + i}" for j in range(n))
    rows = [(i, body(junk, i, 900), "en", "s", 0) for i in range(20)] + [(20 + i, body(good, i, 9), "en", "s", 0) for i in range(20)]
    rows += [(40, "\n".join(["x" * 3 * SAMPLE_CHARS]), "en", "s", 0)]
    assert len(rows[0][1]) > SAMPLE_CHARS
    frame = spark.createDataFrame(rows, SCHEMA)
    labels = spark.createDataFrame([(i, int(20 <= i < 40)) for i in range(60)], "doc_id bigint, quality int")
    got = {r["doc_id"]: r["content_share"] for r in judge(frame, fit_from_labels(frame, labels)).collect()}
    assert max(got[i] for i in range(20)) < 0.5 < min(got[i] for i in range(20, 40))


# --- 6 byte-level BPE ---------------------------------------------------------


def test_byte_bpe_equals_the_library(docs, plain):
    import public_tokenizers
    from tokenizers import Tokenizer

    from cofreq.llm.bpe import decode_documents, encode_documents, round_trip

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    library.no_truncation()
    library.no_padding()
    expected = []
    for d, t in plain:
        ids = library.encode(t or "", add_special_tokens=False).ids
        back = library.decode(ids, skip_special_tokens=False)
        expected.append((d, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(),
                         hashlib.sha256(back.encode()).hexdigest()))
    assert by_id(round_trip(docs, leaf_bytes=64), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == sorted(expected)
    again = decode_documents(encode_documents(docs))
    assert by_id(again, "doc_id", "text") == sorted((d, t or "") for d, t in plain)


@pytest.mark.parametrize("leaf", [16, 64, 257])
def test_tree_concatenation(leaf):
    import public_tokenizers
    from tokenizers import Tokenizer

    from cofreq.llm.bpe import ByteBpe

    library, own, rnd = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), ByteBpe(leaf_bytes=leaf), random.Random(leaf)
    odd = ["a" * 5000, "ab" * 2500, "!" * 3000, " " * 900 + "x", "é" * 1500, "x\n\n\n y  z \n", "日本" * 800, "0123456789" * 300,
           "".join(rnd.choice("theingandoniser") for _ in range(12_000)), "<|endoftext|>" + "-" * 400 + "<|endoftext|>",
           "".join(rnd.choice("abcXYZ019+/") for _ in range(6000))]
    for t in odd:
        ids = own.encode(t)
        assert ids == library.encode(t, add_special_tokens=False).ids
        assert own.decode(ids) == library.decode(ids, skip_special_tokens=False)


# --- 7 main text --------------------------------------------------------------


def article(page):
    import html as h

    inner = re.search(r"(?s)<article>(.*?)(</article>|\Z)", page).group(1)
    return " ".join(h.unescape(re.sub(r"</?b>", "", re.sub(r"</?(p|h1|br)>", " ", inner))).split())


def test_main_text(spark):
    from cofreq.llm.main_text import extract, fit

    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    net = fit(pages)
    got = {r["page_id"]: r for r in extract(pages, net).collect()}
    rows = pages.collect()
    assert len(got) == len(rows)
    assert np.mean([got[r["page_id"]]["text"] == article(r["html"]) for r in rows]) >= 0.98
    long = "Some words of the story that go on for quite a while, one after another."
    odd = [(1, None, None), (2, "u", ""), (3, "u", "<p"), (None, "u", "<main><p>" + long + "</p>" * 3),
           (5, "u", f"<div class='post-content'><p>{long}</p><div class='comments'><p>{long} No.</p></div></div>"
                    f"<aside><p>{long}</p></aside><form>{long}</form><script>var a='<p>x</p>'</script>"),
           (6, "u", "<article>" + f"<p>{long}" * 3000), (7, "u", "<nav><a href=x>a</a></nav>")]
    frame = spark.createDataFrame(odd * 2, "page_id bigint, url string, html string").withColumn("text", F.lit("x"))
    out = {r["page_id"]: r["text"] for r in extract(frame, net).collect()}
    assert out == {1: "", 2: "", 3: "", None: long, 5: long, 6: " ".join([long] * 3000), 7: ""}
    assert extract(frame.limit(0), net).count() == 0


def test_markup_of_ordinary_pages():
    from cofreq.llm.main_text import blocks

    read = lambda page: [(tuple(p[0] for p in path), text) for path, text, _ in blocks(page)]
    uri = "data:image/png;base64," + "iVBORw0KGgo+/" * 2000
    # long attribute values, of an inline element and of a container
    assert read(f'<p>one <img src="{uri}"> two</p>') == [(("p",), "one two")]
    assert read(f"<div><section data-x='{uri} > {uri}'><p>one</p></section><p>two</p></div>") == [
        (("div", "section", "p"), "one"), (("div", "p"), "two")]
    # self-closed svg, elements whose names begin like those of skipped ones
    assert read('<p>one</p><svg class="i" /><p>two</p><svg><text>no</text></svg><p>three</p>') == [
        (("p",), "one"), (("p",), "two"), (("p",), "three")]
    assert read("<button-bar><p>one</p></button-bar><p>two</p><button>no</button>") == [
        (("button-bar", "p"), "one"), (("p",), "two")]
    # quotes that are no values, unclosed quotes and tags
    assert read("<p don't>one</p><p class=\"a\"\">two</p>") == [(("p",), "one"), (("p",), "two")]
    assert read('<p title="a>one</p><p>two</p>') == [(("p",), "one"), (("p",), "two")]
    assert read("one<!-- a > b --><p>two</p>three <a href='x") == [((), "one"), (("p",), "two"), ((), "three")]
    # such pages take linear time
    for page in ('<a x="', "<a ", '<a x=">"', "<svg ", "<a<", "<!--", "<p title='\">"):
        blocks(page * 50_000)


def test_main_text_of_long_pages(spark):
    from cofreq.llm.main_text import SAMPLE_CHARS, extract, fit, window

    story = lambda i: f"Part {i} of the story goes on for quite a while, one word after another, to its end."
    page = lambda k: ("<nav><a href=x>Home</a></nav>" + "<article>" + "".join(f"<p>{story(i + k)}</p>" for i in range(600))
                      + "</article><div class='comments'>" + f"<p>{story(k)} I agree.</p>" * 9 + "</div><footer>Terms</footer>")
    pages = [page(k) for k in range(30)]
    assert all(len(p) > 30_000 for p in pages)
    found, first, total = window(pages[0])
    assert 0 < len(found) < total and sum(len(t) for _, t, _ in found) <= SAMPLE_CHARS and first + len(found) <= total
    assert len({window(p)[1] for p in pages}) > 10
    one, _, _ = window("<p>" + "word " * 50_000)
    assert len(one) == 1 and len(one[0][1]) <= SAMPLE_CHARS
    frame = spark.createDataFrame([(i, "u", p) for i, p in enumerate(pages)], "page_id bigint, url string, html string")
    net = fit(frame)
    assert net is not None
    out = {r["page_id"]: r["text"] for r in extract(frame, net).collect()}
    assert out == {k: " ".join(story(i + k) for i in range(600)) for k in range(30)}
    # nothing to train on: weak labels
    assert fit(frame.where("page_id < 0")) is None
    assert extract(frame.where("page_id = 3"), None).first()["text"] == out[3]


def test_block_features_read_all_words(monkeypatch):
    from cofreq.llm import main_text

    block = lambda middle: ((("p",),), "a " * 40 + middle + " z" * 40, 0)
    one, two = (main_text.features([block(m)]) for m in ("privacy " * 20 + "cookies", "ocean " * 20 + "islands"))
    assert (one != two).any()
    tails = [main_text.features([((("p",),), "x" * 30 + c, 0)]) for c in "abcd"]
    assert any((t != tails[0]).any() for t in tails)
    # training sees the last blocks of long pages too
    seen = set()
    padded = main_text._padded
    monkeypatch.setattr(main_text, "_padded", lambda seqs: [seen.update(s[:, -2]) for s in seqs] and padded(seqs))
    main_text.train([[((("p",),), f"word {i} and so on", 0) for i in range(400)] for _ in range(20)], epochs=1)
    assert max(seen) > 0.9 and min(seen) < 0.1


def test_lstm_gradients():
    from cofreq.llm.main_text import BiLstm

    rng = np.random.default_rng(0)
    net = BiLstm(4, 3)
    x, mask = rng.standard_normal((5, 2, 4)), np.ones((5, 2), bool)
    mask[3:, 1] = False
    x[3:, 1] = 0
    y = (rng.random((5, 2)) > 0.5) * mask
    loss = lambda: ((np.logaddexp(0, net.logits(x, mask)) - y * net.logits(x, mask)) * mask).sum() / mask.sum()
    g = net.gradients(x, mask, y)
    for k, v in net.p.items():
        i = tuple(rng.integers(s) for s in v.shape)
        v[i] += 1e-5
        up = loss()
        v[i] -= 2e-5
        assert abs((up - loss()) / 2e-5 - g[k][i]) < 1e-6
        v[i] += 1e-5


# --- 8 sharding ---------------------------------------------------------------


def test_sharding(docs, plain):
    from cofreq.llm.sharding import vector_shards

    rows = vector_shards(docs, 4).collect()
    assert sorted((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == sorted(
        (d, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for d, t in plain)
    for s in {r["shard"] for r in rows}:
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(sum(r["shard"] == s for r in rows)))


def test_sharding_balances_hot_texts(spark):
    from cofreq.llm.sharding import vector_shards

    rnd = random.Random(5)
    rows = ["hot text " * 30] * 900 + ["w " * rnd.randint(5, 400) + str(i) for i in range(2000)]
    got = vector_shards(documents(spark, rows), 8).groupBy("shard").agg(F.sum("size").alias("b"), F.count("*").alias("n")).collect()
    load = [r["b"] for r in got]
    assert len(load) == 8 and max(load) - min(load) < 0.01 * sum(load) / 8


# --- 9 personal data ----------------------------------------------------------

FORMATS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(number):
    digits = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(number))]
    return sum(d - 9 if d > 9 else d for d in digits) % 10 == 0


def brute_spans(text):
    out = []
    for k, (kind, pattern) in enumerate(FORMATS.items()):
        for m in re.finditer(pattern, text or ""):
            d = re.sub("[^0-9]", "", m.group())
            good = {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m.group().split(".")),
                    "card": 14 <= len(d) <= 19 and luhn(d or "1"), "phone": 10 <= len(d) <= 15}[kind]
            if good:
                out.append((m.start(), k, m.end(), kind))
    return ",".join(f"{kind}:{a}:{b}" for a, _, b, kind in sorted(out))


ODD_PII = ["a@b.c%d@e.f x@y..z", "1.2.3.4.5 300.1.1.1 001.2.3.255", "4111 1111  1111 1111 4111-1111-1111-1111 4 1 1",
           "é😀 a@b.co", "x@a.b@c.d", "12" * 50 + "@q.r", "+1 234 567 8901...", "a@-.b", " 4111111111111111 ", "0.0.0.0.",
           " ".join(f"n{i}@x.yz" for i in range(700)), "9" * 30_000, "1 " * 9000, "a." * 9000, "1.2.3.4.5.6.7.8", "+" * 50]


def test_pii_base_spans(spark, docs, plain):
    from cofreq.llm.pii import Trees, detect, digest

    frame = documents(spark, [*texts(), *ODD_PII])
    never = Trees(-9.0, [], [1e9] * 4)
    got = by_id(digest(detect(clashing(frame), never)), "doc_id", "base_sha256", "spans")
    assert got == sorted((r["doc_id"], hashlib.sha256(brute_spans(r["text"]).encode()).hexdigest(), brute_spans(r["text"]))
                         for r in frame.collect())


def test_pii_added_spans_and_redaction(spark):
    from cofreq.llm.pii import detect, digest, fit, redact

    real = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = fit(real)
    rows = ["reach joe (at) ex (dot) com today", "call (555) 123-4567 now", "at the. Thing at home", "a@b.co +1 (234) 555-6789.", None]
    frame = clashing(documents(spark, rows)).dropDuplicates(["doc_id"]).where("doc_id < 5")
    got = {r["doc_id"]: r for r in digest(detect(frame, model)).collect()}
    assert got[0]["spans"] == "email:6:27" and got[1]["spans"] == "phone:5:19" and got[2]["spans"] == ""
    assert got[0]["base_sha256"] == hashlib.sha256(b"").hexdigest()
    text = {r["doc_id"]: r["text"] for r in redact(frame, model).collect()}
    assert text == {0: "reach [EMAIL] today", 1: "call [PHONE] now", 2: rows[2], 3: "[EMAIL] [PHONE].", 4: None}
    assert redact(frame, model).columns == frame.columns
    # nothing is added to the corpus' own clean text
    assert digest(detect(real, model)).where(F.col("spans") == "").count() > 0.8 * real.count()
    assert not fit(real.limit(0)).trees


def test_pii_candidates_of_all_kinds(spark):
    from cofreq.llm.pii import FEATURES, KINDS, detect, digest, fit

    v6 = "2001:0db8:85a3:0000:0000:8a2e:0370:7334"
    taken = {"reach joe (at) ex (dot) com today": "email:6:27", "write to jo at example dot com": "email:9:30",
             f"ping {v6} now": "ip:5:44", f"it came from {v6}.": "ip:13:52", "card 4111.1111.1111.1111 ok": "card:5:24",
             "we used 4111_1111_1111_1111 then": "card:8:27", "phone: 555.234.4567": "phone:7:19", "or 555-234-4567.": "phone:3:15"}
    left = ["look at red dot now", "apples (at) 3.50 each", "key 01:23:45:67:89:ab:cd:ef", "score 1:2:3:4:5:6:7:8",
            "serial no. 4111.1111.1111.1112", "order no. 1234.5678.9012.3456", "part 123 456 7890 is", "order 123-456-7890"]
    # also where many base matches of the sample fail their test, and where there are none
    failing = documents(spark, [f"see 300.{i}.1.1 and 41111111111{i:05d} +12 or +1 (234) 555-6{i:03d}, a{i}@b.co" for i in range(60)])
    for corpus in (spark.read.parquet(f"{SF}/documents.parquet"), failing, documents(spark, ["no digit"])):
        model = fit(corpus)
        assert "valid" not in FEATURES and len(model.threshold) == len(KINDS) and max(model.threshold) < 100
        frame = documents(spark, [*taken, *left]).dropDuplicates(["doc_id"])
        got = {r["doc_id"]: r["spans"] for r in digest(detect(frame, model)).collect()}
        assert [got[i] for i in range(len(got))] == [*taken.values(), *[""] * len(left)]


def test_pii_needs_cover_the_formats(spark):
    from cofreq.llm.pii import Trees, detect, digest, redact

    single = [" ".join("4111111111111111"), "pay " + "-".join("4111111111111111") + "!", "é 4-1 1-1 1 1 1 1 1 1 1 1 1 1 1 1"]
    frame = documents(spark, single)
    got = by_id(digest(detect(frame, Trees(-9.0, [], [1e9] * 4))), "n_card", "base_sha256", "spans")
    spans = [brute_spans(t) for t in single]
    assert all(spans) and got == sorted((1, hashlib.sha256(x.encode()).hexdigest(), x) for x in spans)
    # redaction finds what detection does, also without a digit
    every = Trees(9.0, [], [0.0] * 4)
    frame = documents(spark, [*single, "at abcd:abcd:abcd:abcd:abcd:abcd:abcd:abcd here"])
    assert by_id(redact(frame, every), "doc_id", "text") == [
        (0, "[CARD]"), (1, "pay [CARD]!"), (2, "é [CARD]"), (3, "at [IP] here")]


# --- 10 nearest neighbours ----------------------------------------------------


def brute_nearest(ids, v, every=20, top=20):
    out = []
    for i in np.flatnonzero(ids % every == 0):
        s = v @ v[i]
        order = [j for j in np.lexsort((ids, -s)) if ids[j] != ids[i]][:top]
        out += [(int(ids[i]), k + 1, int(ids[j])) for k, j in enumerate(order)]
    return sorted(out)


def test_nearest_recall(spark, monkeypatch):
    from cofreq.llm import ann

    monkeypatch.setattr(ann, "CELL_ROWS", 40)  # several cells even here
    monkeypatch.setattr(ann, "PART_ROWS", 30)
    frame = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    local = frame.toPandas()
    got = by_id(ann.nearest(frame), "query_id", "rank", "vec_id")
    truth = brute_nearest(local["vec_id"].to_numpy(), np.stack(local["embedding"]).astype(float))
    assert len(got) == len(truth)
    pairs = lambda rows: {(q, v) for q, _, v in rows}
    assert len(pairs(got) & pairs(truth)) >= 0.9 * len(truth)


def test_nearest_cases(spark):
    from cofreq.llm.ann import nearest

    rows = [(0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [2.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [float("nan"), 1.0]),
            (6, [None, 1.0]), (7, [1.0, 2.0, 3.0]), (None, [1.0, 1.0]), (20, [-1.0, 1.0]), (20, [-1.0, 1.0]), (8, [float("inf"), 1.0])]
    frame = clashing(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>"))
    got = by_id(nearest(frame), "query_id", "rank", "vec_id", "score")
    assert got == [(0, 1, 1, 2.0), (0, 2, 2, 2.0), (0, 3, 20, -1.0), (20, 1, 0, -1.0), (20, 2, 1, -2.0), (20, 3, 2, -2.0)]
    assert nearest(frame.limit(0)).count() == 0


def test_nearest_of_isolated_vectors(spark, monkeypatch):
    from cofreq.llm import ann

    monkeypatch.setattr(ann, "CELL_ROWS", 10)
    monkeypatch.setattr(ann, "PART_ROWS", 30)
    rng = np.random.default_rng(2)
    unit = lambda x: x / np.linalg.norm(x, axis=1)[:, None]
    centres = unit(rng.standard_normal((12, 16)))
    v = centres[rng.integers(12, size=3000)] + 0.02 * rng.standard_normal((3000, 16))
    v[[0, 1000, 2000]] = unit(-centres[:3] - centres[3:6])  # three queries far from every cluster
    frame = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id bigint, embedding array<double>")
    rounds, search = [], ann._search
    monkeypatch.setattr(ann, "_search", lambda *a: rounds.append(a[2].k) or search(*a))
    got = by_id(ann.nearest(frame), "query_id", "rank", "vec_id")
    truth = brute_nearest(np.arange(3000), v)
    assert len(rounds) > 1  # some queries did need another round
    assert [g[:2] for g in got] == [t[:2] for t in truth]
    pairs = lambda rows: {(q, x) for q, _, x in rows}
    assert len(pairs(got) & pairs(truth)) >= 0.8 * len(truth)


# --- all ----------------------------------------------------------------------


def test_empty_tables(spark):
    from cofreq.llm import bpe, jaccard_join, langid, line_crf, packing, pii, repeats, sharding

    none = documents(spark, [])
    assert jaccard_join.jaccard_components(none).count() == 0
    assert jaccard_join.keep_first(none).count() == 0
    assert packing.pack(none).count() == 0
    assert bpe.round_trip(none).count() == 0
    assert sharding.vector_shards(none).count() == 0
    assert repeats.digest(none, repeats.repeated_spans(none)).count() == 0
    assert repeats.strip(none, repeats.repeated_spans(none)).count() == 0
    assert langid.fit_dictionaries(none) == {}
    assert langid.identify(none, {}).count() == 0
    assert line_crf.judge(none, line_crf.fit([], [])).count() == 0
    assert pii.digest(pii.detect(none, pii.fit(none))).count() == 0


def test_null_ids(spark):
    from cofreq.llm import bpe, jaccard_join, packing, repeats, sharding

    rows = [(None, "a b c d e f g h " * 30, None, None, None), (3, "a b c d e f g h " * 30, None, None, None),
            (None, None, None, None, None)]
    frame = spark.createDataFrame(rows, SCHEMA)
    assert repeats.digest(frame, repeats.repeated_spans(frame)).where("n_removed > 0").count() == 2
    assert {(r["doc_id"], r["component_id"]) for r in jaccard_join.jaccard_components(frame).collect()} == {
        (None, 3), (3, 3), (None, None)}
    assert packing.pack(frame).count() == bpe.round_trip(frame).count() == sharding.vector_shards(frame).count() == 3


def test_queries_are_registered():
    import __spark_entry__ as entry

    names = set(entry.queries())
    assert {n.split("_")[0] for n in names if re.match(r"op\d+_", n)} == {f"op{i}" for i in range(1, 14)}
    assert ("pipeline" in names) == os.path.exists(os.path.join(os.path.dirname(entry.__file__), "corpus_pipeline.py"))
