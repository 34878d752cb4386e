"""DuckDB SQL for those queries that SQL can express over whole tables."""

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
_ORDER = "ORDER BY lim / weight, source NULLS LAST"

SQL: dict[str, str] = {
    "op1_source_mixing": f"""
WITH s AS (SELECT doc_id, source, CAST(len({_WORDS}) AS BIGINT) AS size, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS ord FROM documents),
src AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM s GROUP BY source),
r AS (SELECT source, source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS turn, source_size * CAST(2 AS DOUBLE) AS lim FROM src),
w AS (SELECT *, CAST(CASE turn WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS DOUBLE) AS weight FROM r),
l AS (SELECT *, row_number() OVER ({_ORDER}) AS place, (CAST(sum(source_size) OVER () AS DOUBLE) * 1.5 - coalesce(sum(lim) OVER ({_ORDER} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(weight) OVER ({_ORDER} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
f AS (SELECT arg_min(level, place) FILTER (level <= lim / weight) AS level FROM l),
g AS (SELECT source, source_size, turn, least(lim, coalesce(f.level * weight, lim)) AS target FROM l, f),
c AS (SELECT s.doc_id, size, source_size, turn, target, CAST(floor(target) AS BIGINT) AS whole, CAST(coalesce(sum(size) OVER (PARTITION BY s.source ORDER BY ord, s.doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before FROM s JOIN g ON s.source IS NOT DISTINCT FROM g.source),
k AS (SELECT *, least(size, greatest(0, whole - before)) + least(size, greatest(0, whole - source_size - before)) AS taken, CASE WHEN target > 0 THEN before / target END AS due FROM c)
SELECT doc_id, size, source_size, target, CAST(taken AS BIGINT) AS taken, CASE WHEN taken > 0 THEN round(CASE turn WHEN 0 THEN (sqrt(greatest(2.25 + due * -2, 0)) - 1.5) / -1 WHEN 1 THEN (sqrt(greatest(0.25 + due * 2, 0)) - 0.5) / 1
 ELSE CASE WHEN due * 1.125 <= 0.625 THEN (sqrt(greatest(1 + due * 1.125 * 2, 0)) - 1) / 1 ELSE 0.5 + (sqrt(greatest(2.25 + (due * 1.125 - 0.625) * -4, 0)) - 1.5) / -2 END END, 9) END AS position FROM k""",
    "op2_substring_dedup": f"""
WITH w AS (SELECT doc_id, {_WORDS} AS a FROM documents),
x AS (SELECT doc_id, i, array_to_string(a[i : i + 19], ' ') AS k FROM (SELECT doc_id, a, unnest(range(1, len(a) - 18)) AS i FROM w)),
d AS (SELECT doc_id, i FROM x QUALIFY row_number() OVER (PARTITION BY k ORDER BY doc_id, i) > 1),
cut AS (SELECT DISTINCT doc_id, i + j AS p FROM d, (SELECT unnest(range(0, 20)) AS j)),
t AS (SELECT doc_id, p, a[p] AS word FROM (SELECT doc_id, a, unnest(range(1, len(a) + 1)) AS p FROM w)),
kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS body FROM t ANTI JOIN cut USING (doc_id, p) GROUP BY doc_id)
SELECT w.doc_id, CAST(len(a) AS BIGINT) AS n_words, CAST(len(a) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(body, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (doc_id)""",
    "op5_minhash_neardup": r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS a FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(a[i : i + 2], ' ') AS g FROM (SELECT doc_id, a, unnest(range(1, greatest(len(a) - 1, least(len(a), 1) + 1))) AS i FROM w)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS both_ FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * both_ >= 85 * (x.n + y.n - both_)),
u AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT a AS node, a AS reach FROM u UNION SELECT r.node, u.b FROM r JOIN u ON r.reach = u.a),
c AS (SELECT node, min(reach) AS least FROM r GROUP BY node)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(c.least, w.doc_id) AS component_id, coalesce(c.least, w.doc_id) = w.doc_id AS kept FROM w LEFT JOIN n USING (doc_id) LEFT JOIN c ON c.node = w.doc_id""",
    "op7_line_dedup": r"""
WITH l AS (SELECT doc_id, source, i, a[i] AS line FROM (SELECT doc_id, source, a, unnest(range(1, len(a) + 1)) AS i FROM (SELECT doc_id, source, string_split(text, chr(10)) AS a FROM documents))),
pages AS (SELECT source, count(*) AS pages FROM documents GROUP BY source),
n AS (SELECT source, line, count(DISTINCT doc_id) AS n FROM l WHERE regexp_matches(line, '[^\x09-\x0D\x20]') GROUP BY source, line),
b AS (SELECT n.source, line FROM n JOIN pages USING (source) WHERE n >= 10 AND n > pages * 0.1),
m AS (SELECT l.*, b.line IS NOT NULL AS gone FROM l LEFT JOIN b ON l.source = b.source AND l.line = b.line)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS text_sha256 FROM m GROUP BY doc_id""",
}
