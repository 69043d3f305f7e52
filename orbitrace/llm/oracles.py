"""DuckDB SQL that gives the same rows as the queries of this package that SQL can express."""

OP4 = r"""
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
g AS (SELECT doc_id, i, ws[i] || chr(1) || ws[i + 1] || chr(1) || ws[i + 2] AS tri
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) > 2)),
d AS (SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, tri) > 1),
p AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS j FROM d) GROUP BY doc_id),
m AS (SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
  CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines,
  CAST(coalesce(p.n, 0) AS BIGINT) AS n_repeat_words
  FROM w LEFT JOIN p ON w.doc_id = p.doc_id),
c AS (SELECT doc_id, n_words, word_chars, n_symbols, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
  n_repeat_words, CAST(len(lines) AS BIGINT) AS n_lines FROM m),
b AS (SELECT *, CAST(CASE WHEN n_words < 50 THEN 1 ELSE 0 END
  + CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END
  + CASE WHEN 10 * n_symbols > n_words THEN 4 ELSE 0 END
  + CASE WHEN word_chars < 3 * n_words OR word_chars > 10 * n_words THEN 8 ELSE 0 END
  + CASE WHEN 100 * n_dup_lines > 50 * n_lines THEN 16 ELSE 0 END AS BIGINT) AS fail_bits FROM c)
SELECT *, (fail_bits & 3) <> 0 AS base_failed, (fail_bits & 31) = 0 AS kept FROM b
"""


def _op11(k: int = 8, rounds: int = 10) -> str:
    """Lloyd's rounds, written out one after the other."""
    steps = [
        """
WITH kept AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, embedding AS e FROM embeddings WHERE len(embedding) = 64
  AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)))),
v AS MATERIALIZED (SELECT r, d, CAST(floor(1024 * CAST(e[d] AS DOUBLE)) AS BIGINT) AS x FROM kept, range(1, 65) AS u(d)),
seeds AS MATERIALIZED (SELECT r, row_number() OVER (ORDER BY sha256('3:' || vec_id)) - 1 AS c FROM kept
  QUALIFY c < {k}),
c0 AS MATERIALIZED (SELECT c, d, x FROM seeds JOIN v USING (r))""".format(k=k)
    ]
    for i in range(rounds + 1):
        steps.append(f"""a{i} AS MATERIALIZED (SELECT r, c, s FROM (SELECT v.r, q.c, sum((v.x - q.x) * (v.x - q.x)) AS s FROM v JOIN c{i} AS q USING (d) GROUP BY ALL)
  QUALIFY row_number() OVER (PARTITION BY r ORDER BY s, c) = 1)""")
        if i < rounds:
            steps.append(f"""m{i} AS MATERIALIZED (SELECT c, d, sum(x) AS s, count(*) AS n FROM v JOIN a{i} USING (r) GROUP BY ALL),
c{i + 1} AS MATERIALIZED (SELECT c{i}.c, c{i}.d, CAST(coalesce((s - ((s % n + n) % n)) // n, c{i}.x) AS BIGINT) AS x FROM c{i} LEFT JOIN m{i} USING (c, d))""")
    steps.append(f"""h AS (SELECT c, sha256(string_agg(x, ',' ORDER BY d)) AS centroid_sha256 FROM c{rounds} GROUP BY c)
SELECT vec_id, CAST(c AS INTEGER) AS cluster, CAST(s AS BIGINT) AS distance, CAST(sum(s) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia,
  CAST(sum(s) OVER () AS BIGINT) AS inertia, centroid_sha256 FROM a{rounds} JOIN kept USING (r) JOIN h USING (c)""")
    return ",\n".join(steps)


OP11 = _op11()

OP12 = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
w AS (SELECT r, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
k AS MATERIALIZED (SELECT lang, term, count(*) AS ln FROM w GROUP BY ALL HAVING count(DISTINCT r) >= 30),
g AS MATERIALIZED (SELECT DISTINCT lang, source FROM d),
n AS MATERIALIZED (SELECT lang, source, term, count(*) AS n FROM w SEMI JOIN k USING (lang, term) GROUP BY ALL),
v AS (SELECT lang, count(*) AS v, sum(ln) AS ln FROM k GROUP BY lang),
t AS (SELECT lang, source, coalesce(s, 0) AS s, v, ln FROM g LEFT JOIN (SELECT lang, source, sum(n) AS s FROM n GROUP BY ALL) USING (lang, source)
  LEFT JOIN v USING (lang)),
p AS MATERIALIZED (SELECT t.lang, t.source, k.term, coalesce(n.n, 0) AS n, 1 + (1000000000 * (coalesce(n.n, 0) + 5)::HUGEINT) // (t.s + 5 * t.v) AS p,
  1 + (1000000000 * (k.ln + 5)::HUGEINT) // (t.ln + 5 * t.v) AS q FROM t JOIN k USING (lang) LEFT JOIN n USING (lang, source, term)),
pv AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p AS a JOIN p AS b USING (lang, term) WHERE a.source <> b.source GROUP BY ALL),
pair AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(value, 0) AS BIGINT) AS value FROM g AS a JOIN g AS b USING (lang)
  LEFT JOIN pv ON pv.lang = a.lang AND pv.source = a.source AND pv.item = b.source WHERE a.source <> b.source),
term AS (SELECT lang, source, 'term' AS part, term AS item, CAST(p - q AS BIGINT) AS value FROM p WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank
  FROM (SELECT * FROM pair UNION ALL SELECT * FROM term)) WHERE part = 'pair' OR rank <= 50
"""

OP13 = r"""
WITH l AS (SELECT doc_id, generate_subscripts(ls, 1) AS i, unnest(ls) AS line FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents)),
k AS (SELECT doc_id, i, line, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
c AS (SELECT key, max(doc_id) AS top FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
f AS (SELECT k.doc_id, i, line, c.key IS NOT NULL AND c.top <> k.doc_id AS gone FROM k LEFT JOIN c USING (key))
SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (gone) AS BIGINT) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256 FROM f GROUP BY doc_id
"""
