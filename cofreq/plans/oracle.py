"""DuckDB oracle SQL for every registered query: the same answers computed
independently with self-joins, GROUP BY/HAVING, window functions and list
functions over the pre-registered table views."""

from __future__ import annotations

from cofreq.sources.basket import BASKET_SQL

DIV = 150
BLOCK = 1 << 16

_LEVELS = f"""
params AS (SELECT count(DISTINCT tid) AS n FROM basket),
f1 AS (SELECT item AS i1, count(*) AS support FROM basket GROUP BY item
       HAVING count(*) * {DIV} >= (SELECT n FROM params)),
fb AS (SELECT tid, item FROM basket WHERE item IN (SELECT i1 FROM f1)),
f2 AS (SELECT a.item AS i1, b.item AS i2, count(*) AS support
       FROM fb a JOIN fb b ON a.tid = b.tid AND a.item < b.item
       GROUP BY 1, 2 HAVING count(*) * {DIV} >= (SELECT n FROM params)),
f3 AS (SELECT a.item AS i1, b.item AS i2, c.item AS i3, count(*) AS support
       FROM fb a JOIN fb b ON a.tid = b.tid AND a.item < b.item
                 JOIN fb c ON c.tid = a.tid AND b.item < c.item
       GROUP BY 1, 2, 3 HAVING count(*) * {DIV} >= (SELECT n FROM params)),
f4 AS (SELECT a.item AS i1, b.item AS i2, c.item AS i3, d.item AS i4, count(*) AS support
       FROM fb a JOIN fb b ON a.tid = b.tid AND a.item < b.item
                 JOIN fb c ON c.tid = a.tid AND b.item < c.item
                 JOIN fb d ON d.tid = a.tid AND c.item < d.item
       WHERE (a.item, b.item, c.item) IN (SELECT (i1, i2, i3) FROM f3)
       GROUP BY 1, 2, 3, 4 HAVING count(*) * {DIV} >= (SELECT n FROM params)),
f5 AS (SELECT a.item AS i1, b.item AS i2, c.item AS i3, d.item AS i4, e.item AS i5, count(*) AS support
       FROM fb a JOIN fb b ON a.tid = b.tid AND a.item < b.item
                 JOIN fb c ON c.tid = a.tid AND b.item < c.item
                 JOIN fb d ON d.tid = a.tid AND c.item < d.item
                 JOIN fb e ON e.tid = a.tid AND d.item < e.item
       WHERE (a.item, b.item, c.item, d.item) IN (SELECT (i1, i2, i3, i4) FROM f4)
       GROUP BY 1, 2, 3, 4, 5 HAVING count(*) * {DIV} >= (SELECT n FROM params)),
fis AS (SELECT [i1] AS items, support FROM f1
        UNION ALL SELECT [i1, i2], support FROM f2
        UNION ALL SELECT [i1, i2, i3], support FROM f3
        UNION ALL SELECT [i1, i2, i3, i4], support FROM f4
        UNION ALL SELECT [i1, i2, i3, i4, i5], support FROM f5)"""


_NAMED_CANDIDATES = """, sold AS (
SELECT DISTINCT TRY_CAST(regexp_extract(p_brand, '(\\d+)$', 1) AS INTEGER) AS brand, n_nationkey + 100 AS nation,
       (n_regionkey + 1) % 5 + 200 AS next_region
FROM lineitem JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey),
cand AS (SELECT DISTINCT brand AS a, nation AS b FROM sold WHERE brand IS NOT NULL
         UNION SELECT DISTINCT nation, next_region FROM sold WHERE brand IS NOT NULL)"""


def _with(body: str) -> str:
    return f"WITH {BASKET_SQL},{_LEVELS}\n{body}"


def _fis_text(where: str = "TRUE", src: str = "fis") -> str:
    return _with(f"SELECT array_to_string(items, ' ') AS itemset, support FROM {src} WHERE {where}")


def _forward_closed(k: int) -> str:
    """The miner's output rule for numeric k-prefix groups (short = all sets
    of length <= k)."""
    return _with(f""",
ext AS (SELECT items[1:{k}] AS grp, items[{k + 1}] AS item, support FROM fis WHERE len(items) = {k + 1}),
rk AS (SELECT grp, item, row_number() OVER (PARTITION BY grp ORDER BY support, item) AS r FROM ext),
memx AS (SELECT items, support, items[1:{k}] AS grp, unnest(items[{k + 1}:]) AS x FROM fis WHERE len(items) > {k}),
memr AS (SELECT m.items, m.support, m.grp, list_sort(list(rk.r)) AS rs
         FROM memx m JOIN rk ON rk.grp = m.grp AND rk.item = m.x GROUP BY m.items, m.support, m.grp),
brk AS (SELECT t.grp, t.rs[1:len(t.rs) - 1] AS seg, t.rs[len(t.rs)] AS ylast
        FROM memr t JOIN memr a ON a.grp = t.grp AND a.rs = t.rs[1:len(t.rs) - 1] AND a.support = t.support
        WHERE len(t.rs) >= 2),
segs AS (SELECT items, grp, rs[1:d] AS seg, CASE WHEN d < len(rs) THEN rs[d + 1] END AS nxt
         FROM (SELECT items, grp, rs, unnest(generate_series(1, len(rs))) AS d FROM memr)),
killed AS (SELECT DISTINCT g.items FROM segs g JOIN brk b ON b.grp = g.grp AND b.seg = g.seg
           WHERE g.nxt IS NULL OR b.ylast < g.nxt),
fc AS (SELECT items, support FROM fis WHERE len(items) <= {k}
       UNION ALL
       SELECT m.items, m.support FROM memr m WHERE NOT EXISTS (SELECT 1 FROM killed x WHERE x.items = m.items))
SELECT array_to_string(items, ' ') AS itemset, support FROM fc""")


def _vertical_forward_closed(p: int, seeds_only: bool = False) -> str:
    """The vertical miner's output in rank space: rank-ordered seeds up to
    length p with the closure break from the first level, then (p-1)-prefix
    groups over the reported length-p seeds, mapped back to item ids."""
    return _with(f""",
rk1 AS (SELECT i1 AS item, row_number() OVER (ORDER BY support, i1) AS r FROM f1),
rf AS (SELECT list_sort(list(rk1.r)) AS ri, f.support
       FROM (SELECT items, support, unnest(items) AS it FROM fis) f JOIN rk1 ON rk1.item = f.it
       GROUP BY f.items, f.support),
sm AS (SELECT ri, support, ri[1:1] AS grp, ri[2:] AS rs FROM rf WHERE len(ri) BETWEEN 2 AND {p}),
sb AS (SELECT t.grp, t.rs[1:len(t.rs) - 1] AS seg, t.rs[len(t.rs)] AS ylast, len(t.ri) AS tlen
       FROM sm t JOIN sm a ON a.grp = t.grp AND a.rs = t.rs[1:len(t.rs) - 1] AND a.support = t.support
       WHERE len(t.rs) >= 2
       UNION ALL
       SELECT t.grp, CAST([] AS BIGINT[]), t.rs[1], len(t.ri)
       FROM sm t JOIN rf g ON g.ri = t.grp AND g.support = t.support WHERE len(t.rs) = 1),
ss AS (SELECT ri, grp, len(ri) AS slen, rs[1:d] AS seg, CASE WHEN d < len(rs) THEN rs[d + 1] END AS nxt
       FROM (SELECT ri, grp, rs, unnest(generate_series(0, len(rs))) AS d FROM sm)),
skill AS (SELECT DISTINCT g.ri FROM ss g JOIN sb b ON b.grp = g.grp AND b.seg = g.seg
          WHERE (g.nxt IS NULL AND g.slen < {p}) OR (g.nxt IS NOT NULL AND b.ylast < g.nxt AND b.tlen < {p})),
seeds AS (SELECT ri, support FROM sm WHERE NOT EXISTS (SELECT 1 FROM skill k WHERE k.ri = sm.ri)),
ext AS (SELECT ri[1:{p - 1}] AS grp, ri[{p}] AS x, support FROM seeds WHERE len(ri) = {p}),
rk AS (SELECT grp, x, row_number() OVER (PARTITION BY grp ORDER BY support, x) AS r FROM ext),
memx AS (SELECT ri, support, ri[1:{p - 1}] AS grp, len(ri) - {p - 1} AS m, unnest(ri[{p}:]) AS x
         FROM rf WHERE len(ri) >= {p}),
memr AS (SELECT m.ri, m.support, m.grp, list_sort(list(rk.r)) AS rs
         FROM memx m JOIN rk ON rk.grp = m.grp AND rk.x = m.x
         GROUP BY m.ri, m.support, m.grp, m.m HAVING count(*) = m.m),
brk AS (SELECT t.grp, t.rs[1:len(t.rs) - 1] AS seg, t.rs[len(t.rs)] AS ylast
        FROM memr t JOIN memr a ON a.grp = t.grp AND a.rs = t.rs[1:len(t.rs) - 1] AND a.support = t.support
        WHERE len(t.rs) >= 2),
segs AS (SELECT ri, grp, rs[1:d] AS seg, CASE WHEN d < len(rs) THEN rs[d + 1] END AS nxt
         FROM (SELECT ri, grp, rs, unnest(generate_series(1, len(rs))) AS d FROM memr)),
killed AS (SELECT DISTINCT g.ri FROM segs g JOIN brk b ON b.grp = g.grp AND b.seg = g.seg
           WHERE g.nxt IS NULL OR b.ylast < g.nxt),
outr AS ({"SELECT ri, support FROM seeds" if seeds_only else f"""SELECT ri, support FROM rf WHERE len(ri) = 1
         UNION ALL SELECT ri, support FROM seeds WHERE len(ri) < {p}
         UNION ALL SELECT ri, support FROM memr WHERE NOT EXISTS (SELECT 1 FROM killed k WHERE k.ri = memr.ri)"""})
SELECT array_to_string(list_sort(list(rk1.item)), ' ') AS itemset, o.support
FROM (SELECT ri, support, unnest(ri) AS r FROM outr) o JOIN rk1 ON rk1.r = o.r
GROUP BY o.ri, o.support""")


def _tid_lists_of_pairs(prefix_cols: str) -> str:
    return _with(f"""
SELECT {prefix_cols}, CAST(floor(a.tid / {BLOCK}) AS BIGINT) AS block,
       string_agg(CAST(a.tid AS VARCHAR), ' ' ORDER BY a.tid) AS tids
FROM f2 p JOIN fb a ON a.item = p.i1 JOIN fb b ON b.tid = a.tid AND b.item = p.i2
GROUP BY ALL""")


def _deep(select: str) -> str:
    """All frequent sets of the dense basket, whatever their length, by a
    recursive query over whole transactions' items (no level is written out)."""
    return f"""
WITH RECURSIVE {BASKET_SQL.strip()},
dense AS (SELECT DISTINCT tid, CAST(CASE WHEN item < 100 THEN item % 4 WHEN item < 200 THEN 10 + item % 3
                 WHEN item < 300 THEN 20 + item % 2 ELSE 30 + item % 2 END AS BIGINT) AS item FROM basket
          UNION SELECT tid, CAST(40 + item % 4 // 2 AS BIGINT) FROM basket WHERE item < 100),
low AS (SELECT CAST(ceil(count(DISTINCT tid) / 50.0) AS BIGINT) AS s FROM basket),
shapes AS (SELECT items, count(*) AS n FROM (SELECT tid, list_sort(list(item)) AS items FROM dense GROUP BY tid) GROUP BY items),
sets(items) AS (
  SELECT CAST([] AS BIGINT[])
  UNION ALL
  SELECT list_append(s.items, i.item) FROM sets s, (SELECT DISTINCT item FROM dense) i
  WHERE (len(s.items) = 0 OR i.item > s.items[len(s.items)])
    AND (SELECT coalesce(sum(n), 0) FROM shapes WHERE list_has_all(shapes.items, list_append(s.items, i.item))) >= (SELECT s FROM low)),
deep AS (SELECT s.items, CAST(sum(h.n) AS BIGINT) AS support FROM sets s JOIN shapes h ON list_has_all(h.items, s.items)
         WHERE len(s.items) > 0 GROUP BY s.items)
{select}"""


# The depth-first miner's output for one-item prefix groups, as a walk: a set is
# visited unless, at some step of its path, an earlier sibling (below the first
# step) kept the whole support of the set it extended; a visited set is
# reported unless a later sibling keeps its support.
_FORWARD_CLOSED_WALK = """
, groups AS (SELECT items[1] AS g, items[2] AS x, support FROM deep WHERE len(items) = 2),
pos AS (SELECT g, x, row_number() OVER (PARTITION BY g ORDER BY support, x) AS r FROM groups),
paths AS (SELECT d.items, d.support, d.items[1] AS g, list(pos.r ORDER BY pos.r) AS path
          FROM (SELECT items, support, unnest(items[2:]) AS x FROM deep WHERE len(items) > 1) d
          JOIN pos ON pos.g = d.items[1] AND pos.x = d.x GROUP BY d.items, d.support, d.items[1]),
keeps AS (SELECT c.g, c.path[1:len(c.path) - 1] AS parent, min(c.path[len(c.path)]) AS first
          FROM paths c JOIN paths p ON p.g = c.g AND p.path = c.path[1:len(c.path) - 1] AND p.support = c.support
          WHERE len(c.path) > 1 GROUP BY ALL)
SELECT array_to_string(items, ' ') AS itemset, support FROM deep WHERE len(items) = 1
UNION ALL
SELECT array_to_string(items, ' '), support FROM paths v
WHERE NOT EXISTS (SELECT 1 FROM keeps k WHERE k.g = v.g AND k.parent = v.path)
  AND NOT EXISTS (SELECT 1 FROM keeps k WHERE k.g = v.g AND len(k.parent) < len(v.path)
                  AND k.parent = v.path[1:len(k.parent)] AND k.first < v.path[len(k.parent) + 1])"""


def oracle_sql() -> dict[str, str]:
    transpose = _with(f"""
SELECT item, CAST(floor(tid / {BLOCK}) AS BIGINT) AS block, count(*) AS support,
       string_agg(CAST(tid AS VARCHAR), ' ' ORDER BY tid) AS tids
FROM basket GROUP BY ALL""")
    apriori = _fis_text()
    return {
        "parse_transactions": _with(
            "SELECT tid, string_agg(CAST(item AS VARCHAR), ' ' ORDER BY item) AS itemset FROM basket GROUP BY tid"),
        "transaction_count": _with("SELECT count(DISTINCT tid) AS n_transactions FROM basket"),
        "frequent_items": _with("SELECT i1 AS item, support FROM f1"),
        "prune_items": _with(
            "SELECT tid, string_agg(CAST(item AS VARCHAR), ' ' ORDER BY item) AS itemset FROM fb GROUP BY tid"),
        "filter_min_length": _with(
            "SELECT tid, CAST(count(*) AS INTEGER) AS n_items FROM basket GROUP BY tid HAVING count(*) >= 6"),
        "item_rank": _with("SELECT i1 AS item, support, row_number() OVER (ORDER BY support, i1) AS rank FROM f1"),
        "transpose": transpose,
        "merge_tids": transpose,
        "generate_candidates": _with("""
SELECT DISTINCT concat_ws(' ', a.item, b.item, c.item) AS itemset
FROM fb a JOIN fb b ON a.tid = b.tid AND a.item < b.item
          JOIN fb c ON c.tid = a.tid AND b.item < c.item
          JOIN f2 p ON p.i1 = a.item AND p.i2 = b.item
          JOIN f2 q ON q.i1 = a.item AND q.i2 = c.item"""),
        "max_candidates": _with("""
SELECT CAST(i1 AS VARCHAR) AS prefix, count(*) AS n_extensions,
       CAST(count(*) * (count(*) - 1) / 2 AS BIGINT) AS max_candidates
FROM f2 GROUP BY i1"""),
        "candidate_support": _with("""
SELECT concat_ws(' ', a.item, b.item, c.item) AS itemset, count(*) AS support
FROM fb a JOIN fb b ON a.tid = b.tid AND a.item < b.item
          JOIN fb c ON c.tid = a.tid AND b.item < c.item
          JOIN f2 p ON p.i1 = a.item AND p.i2 = b.item
          JOIN f2 q ON q.i1 = a.item AND q.i2 = c.item
GROUP BY 1"""),
        "containment_support": _with(f"""{_NAMED_CANDIDATES}
SELECT concat_ws(' ', c.a, c.b) AS itemset, count(y.tid) AS support
FROM cand c LEFT JOIN basket x ON x.item = c.a LEFT JOIN basket y ON y.tid = x.tid AND y.item = c.b GROUP BY 1"""),
        "containment_tids": _with(f"""{_NAMED_CANDIDATES}, hits AS (
SELECT c.a, c.b, x.tid FROM cand c JOIN basket x ON x.item = c.a JOIN basket y ON y.tid = x.tid AND y.item = c.b)
SELECT concat_ws(' ', c.a, c.b) AS itemset, CAST(floor(h.tid / {BLOCK}) AS BIGINT) AS block,
       coalesce(string_agg(CAST(h.tid AS VARCHAR), ' ' ORDER BY h.tid), '') AS tids
FROM cand c LEFT JOIN hits h ON h.a = c.a AND h.b = c.b GROUP BY c.a, c.b, CAST(floor(h.tid / {BLOCK}) AS BIGINT)"""),
        "grouped_length_counts": _with("SELECT CAST(len(items) AS INTEGER) AS level, count(*) AS n FROM fis WHERE len(items) > 1 GROUP BY 1"),
        "candidate_tids": _tid_lists_of_pairs("concat_ws(' ', p.i1, p.i2) AS itemset"),
        "prefix_groups": _with(f"""
SELECT CAST(p.i1 AS VARCHAR) AS prefix, p.i2 AS item, p.support, CAST(floor(a.tid / {BLOCK}) AS BIGINT) AS block,
       string_agg(CAST(a.tid AS VARCHAR), ' ' ORDER BY a.tid) AS tids
FROM f2 p JOIN fb a ON a.item = p.i1 JOIN fb b ON b.tid = a.tid AND b.item = p.i2
GROUP BY ALL"""),
        "intersect_tids": _tid_lists_of_pairs("concat_ws(' ', p.i1, p.i2) AS itemset"),
        "diff_tids": _with("""
SELECT concat_ws(' ', p.i1, p.i2) AS itemset, p.support, s.support - p.support AS diff_size
FROM f2 p JOIN f1 s ON s.i1 = p.i1"""),
        "prefix_group_stats": _with("""
SELECT count(*) AS n_groups, count(*) FILTER (WHERE total > 3000) AS n_large_groups,
       max(total) AS max_total
FROM (SELECT i1, CAST(sum(support) AS BIGINT) AS total FROM f2 GROUP BY i1)"""),
        "apriori": apriori,
        "vertical_mine": apriori,
        "hybrid_mine": apriori,
        "seed_prefixes": _vertical_forward_closed(3, seeds_only=True),
        "closed_itemsets": _with("""
SELECT array_to_string(s.items, ' ') AS itemset, s.support FROM fis s
WHERE NOT EXISTS (SELECT 1 FROM fis t WHERE len(t.items) = len(s.items) + 1
                  AND t.support = s.support AND list_has_all(t.items, s.items))"""),
        "maximal_itemsets": _with("""
SELECT array_to_string(s.items, ' ') AS itemset, s.support FROM fis s
WHERE NOT EXISTS (SELECT 1 FROM fis t WHERE len(t.items) = len(s.items) + 1
                  AND list_has_all(t.items, s.items))"""),
        "forward_closed_itemsets": _forward_closed(1),
        "adaptive_depth": apriori,
        "length_counts": _with("""
SELECT COALESCE(CAST(len(items) AS VARCHAR), 'Total') AS level, count(*) AS cnt
FROM fis GROUP BY ROLLUP (len(items))"""),
        "itemset_total": _with("SELECT count(*) AS n_itemsets FROM fis"),
        "all_results": _forward_closed(2),
        "encode_short_itemsets": _with("""
SELECT count(*) AS n,
       coalesce(array_to_string(items[1:len(items) - 1], '|') || '|', '')
       || string_agg(CAST(items[len(items)] AS VARCHAR) || '(' || CAST(support AS VARCHAR) || ')', '$' ORDER BY items[len(items)]) AS encoded
FROM (SELECT items, support, CASE WHEN len(items) > 1 THEN items[1:len(items) - 1] END AS p FROM fis)
GROUP BY p, coalesce(array_to_string(items[1:len(items) - 1], '|') || '|', ''), items[len(items)] // 10""").replace(
            "coalesce(array_to_string(items[1:len(items) - 1], '|') || '|', '')",
            "(CASE WHEN len(items) > 1 THEN array_to_string(items[1:len(items) - 1], '|') || '|' ELSE '' END)"),
        "encoded_lines": _with("""
SELECT '1' || chr(9) || array_to_string(items, '|') || '(' || CAST(support AS VARCHAR) || ')' AS value FROM fis"""),
        "grouped_all_heavy": apriori,
        "grouped_vertical_forward_closed": _vertical_forward_closed(3),
        "duplicate_rows": apriori,
        "facade_closed_max_len": _with("""
SELECT array_to_string(s.items, ' ') AS itemset, s.support FROM fis s
WHERE len(s.items) <= 2 AND NOT EXISTS (SELECT 1 FROM fis t WHERE len(t.items) = len(s.items) + 1
                  AND t.support = s.support AND list_has_all(t.items, s.items))"""),
        "diffset_extend": _with("""
SELECT concat_ws(' ', a.item, b.item, c.item) AS itemset, count(*) AS support
FROM fb a JOIN fb b ON a.tid = b.tid AND a.item < b.item
          JOIN fb c ON c.tid = a.tid AND b.item < c.item
          JOIN f2 p ON p.i1 = a.item AND p.i2 = b.item
          JOIN f2 q ON q.i1 = a.item AND q.i2 = c.item
          JOIN f2 r ON r.i1 = b.item AND r.i2 = c.item
GROUP BY 1"""),
        "apriori_deep": _deep("SELECT array_to_string(items, ' ') AS itemset, support FROM deep"),
        "vertical_deep": _deep("SELECT array_to_string(items, ' ') AS itemset, support FROM deep"),
        "closed_deep": _deep("""
SELECT array_to_string(s.items, ' ') AS itemset, s.support FROM deep s
WHERE NOT EXISTS (SELECT 1 FROM deep t WHERE len(t.items) > len(s.items) AND t.support = s.support
                  AND list_has_all(t.items, s.items))"""),
        "forward_closed_deep": _deep(_FORWARD_CLOSED_WALK),
        "transaction_files": _with("""
SELECT itemset, count(*) AS n FROM (SELECT tid, string_agg(CAST(item AS VARCHAR), ' ' ORDER BY item) AS itemset
FROM basket GROUP BY tid) GROUP BY itemset"""),
        "itemset_table_files": apriori,
        "vertical_files": transpose,
        "result_files": _with("""
SELECT array_to_string(items, ' ') AS itemset, support, CASE WHEN len(items) <= 2 THEN 'short' ELSE 'long' END AS kind
FROM fis"""),
        "encode_decode_roundtrip": apriori,
        "grouped_forward_closed": _forward_closed(1),
        "vertical_forward_closed": _vertical_forward_closed(3),
        "grouped_all": apriori,
        "itemset_text": _with(
            "SELECT array_to_string(items, ' ') || ' (' || CAST(support AS VARCHAR) || ')' AS value FROM fis"),
    }
