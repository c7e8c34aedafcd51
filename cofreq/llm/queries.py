"""One query for each operator, over its whole table, with the columns of its
contract; ``ORACLE_SQL`` has the DuckDB form where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cofreq.llm.common import table


def op1_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base rules and the line field's verdict for all documents."""
    from cofreq.llm.line_crf import fit_from_labels, judge

    docs = table(spark, sf_dir, "documents")
    return judge(docs, fit_from_labels(docs, table(spark, sf_dir, "labels")))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Removal of every repeated 200-byte string from all documents."""
    from cofreq.llm.repeats import digest, repeated_spans

    docs = table(spark, sf_dir, "documents")
    return digest(docs, repeated_spans(docs))


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jaccard join of all documents: 3-word shingles, similarity 0.9."""
    from cofreq.llm.jaccard_join import jaccard_components

    return jaccard_components(table(spark, sf_dir, "documents"), 3, 90, 100)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hierarchical multi-length packing of all documents."""
    from cofreq.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language by compression; fitted on documents that are not held out."""
    from cofreq.llm.langid import fit_dictionaries, identify

    docs = table(spark, sf_dir, "documents")
    held_out = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3)) == 1
    dicts = fit_dictionaries(docs.where(~held_out))
    return identify(docs, dicts).select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "lang_pred",
                                        "score", "rejected")


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tree-concatenation BPE round trip of all documents."""
    from cofreq.llm.bpe import round_trip

    return round_trip(table(spark, sf_dir, "documents"))


def op7_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of all pages by the recurrent block labeller."""
    from cofreq.llm.main_text import extract, fit

    pages = table(spark, sf_dir, "pages")
    return extract(pages, fit(pages))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vector bin packing of all documents into 24 shards; law: bytes."""
    from cofreq.llm.sharding import vector_shards

    return vector_shards(table(spark, sf_dir, "documents"), 24).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base and added spans of personal data in all documents."""
    from cofreq.llm.pii import detect, digest, fit

    docs = table(spark, sf_dir, "documents")
    return digest(detect(docs, fit(docs)))


def op10_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Multiprobe p-stable search: 20 nearest of every 20th vector."""
    from cofreq.llm.ann import nearest

    return nearest(table(spark, sf_dir, "embeddings"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phrases of 2 to 5 words with 100 occurrences, the first 2000 of each language."""
    from cofreq.llm.collocations import top_collocations

    return top_collocations(table(spark, sf_dir, "documents"), 2000).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op12_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equal texts of all documents; the largest doc_id stays."""
    from cofreq.llm.exact_dedup import exact_duplicates

    return exact_duplicates(table(spark, sf_dir, "documents"), keep="largest")


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Divergence of the sources of each language, by pair and by term."""
    from cofreq.llm.source_audit import divergences

    return divergences(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (
    op1_line_quality, op2_suffix_dedup, op3_ngram_join, op4_packing, op5_language_id, op6_byte_bpe, op7_main_text, op8_sharding,
    op9_pii, op10_nearest, op11_collocations, op12_exact_dedup, op13_source_divergence)}

_LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_COLLOCATIONS = f"""
WITH docs AS (SELECT coalesce(lang, 'und') AS lang, {_LOWERED} AS t FROM documents),
pieces AS (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM docs),
runs AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM pieces),
totals AS (SELECT lang, sum(len(w)) AS n FROM runs GROUP BY lang),
starts AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM runs),
grams AS (SELECT lang, w[i:i + m - 1] AS g FROM starts, range(1, 6) AS lens(m) WHERE i + m - 1 <= len(w)),
f AS (SELECT lang, g, count(*) AS f FROM grams GROUP BY lang, g HAVING count(*) >= 100),
inner_phrases AS (SELECT lang, s, max(f) AS f FROM (
  SELECT p.lang, q.g[x.i:x.i + len(p.g) - 1] AS s, q.f FROM (SELECT DISTINCT lang, g FROM f WHERE len(g) > 1) p
  JOIN (SELECT lang, g, f FROM f WHERE len(g) > 2) q ON p.lang = q.lang AND len(q.g) > len(p.g) AND list_contains(q.g, p.g[1])
  CROSS JOIN range(1, 6) AS x(i) WHERE x.i + len(p.g) - 1 <= len(q.g) AND q.g[x.i:x.i + len(p.g) - 1] = p.g) GROUP BY lang, s),
cand AS (SELECT f.lang, f.g, f.f AS a FROM f LEFT JOIN inner_phrases b ON f.lang = b.lang AND f.g = b.s
  WHERE len(f.g) > 1 AND (b.f IS NULL OR 100 * b.f < 100 * f.f)),
cuts AS (SELECT c.lang, c.g, c.a, k, l.f AS l, r.f AS r, t.n,
  (1000::HUGEINT * c.a * t.n) // (l.f::HUGEINT * r.f) AS score
  FROM cand c CROSS JOIN range(1, 5) AS cut(k) JOIN f l ON l.lang = c.lang AND l.g = c.g[1:k]
  JOIN f r ON r.lang = c.lang AND r.g = c.g[k + 1:] JOIN totals t ON t.lang = c.lang WHERE k < len(c.g)),
weakest AS (SELECT lang, array_to_string(g, ' ') AS phrase, a, l, r, n, score FROM cuts
  QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM weakest)
SELECT lang, rank::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score
FROM ranked WHERE rank <= 2000
"""

_EXACT_DEDUP = f"""
WITH d AS (SELECT doc_id, sha256({_LOWERED}) AS text_sha256, {_LOWERED} AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, d.text_sha256 FROM d JOIN g ON d.t = g.t
"""

_DIVERGENCE = f"""
WITH docs AS (SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  regexp_extract_all({_LOWERED}, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
occ AS (SELECT row, lang, source, unnest(terms) AS term FROM docs),
kept AS (SELECT lang, term, count(*) AS c FROM occ GROUP BY lang, term HAVING count(DISTINCT row) >= 3),
v AS (SELECT lang, count(*) AS v, sum(c) AS total FROM kept GROUP BY lang),
groups AS (SELECT DISTINCT lang, source FROM docs),
held AS (SELECT o.lang, o.source, o.term, count(*) AS c FROM occ o JOIN kept k ON o.lang = k.lang AND o.term = k.term
  GROUP BY o.lang, o.source, o.term),
sizes AS (SELECT lang, source, sum(c) AS total FROM held GROUP BY lang, source),
shares AS (SELECT g.lang, g.source, k.term, coalesce(h.c, 0) AS c,
  1 + (1000000000::HUGEINT * (coalesce(h.c, 0) + 1)) // (coalesce(s.total, 0) + v.v)::HUGEINT AS p,
  1 + (1000000000::HUGEINT * (k.c + 1)) // (v.total + v.v)::HUGEINT AS q
  FROM groups g JOIN kept k ON g.lang = k.lang JOIN v ON v.lang = g.lang
  LEFT JOIN held h ON h.lang = g.lang AND h.source = g.source AND h.term = k.term
  LEFT JOIN sizes s ON s.lang = g.lang AND s.source = g.source),
sums AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value FROM shares a
  JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source),
parts AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0) AS value FROM groups a
  JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
  UNION ALL SELECT lang, source, 'term', term, ((p - q) * (p - q)) // q FROM shares WHERE c > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM parts)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM ranked WHERE part = 'pair' OR rank <= 200
"""

ORACLE_SQL: dict[str, str] = {"op11_collocations": _COLLOCATIONS, "op12_exact_dedup": _EXACT_DEDUP,
                              "op13_source_divergence": _DIVERGENCE}
