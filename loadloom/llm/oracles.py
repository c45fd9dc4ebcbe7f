"""DuckDB SQL for the queries that SQL can express on whole tables."""

ORACLES = {
    "op8_line_dedup": r"""
WITH worded AS (
  SELECT d.doc_id, d.text, d.source, u.line, u.position, regexp_matches(u.line, '[^\x20\x09-\x0D]') AS has_word
  FROM documents d, LATERAL (SELECT unnest(string_split(d.text, chr(10))) AS line, generate_subscripts(string_split(d.text, chr(10)), 1) AS position) u
), widespread AS (SELECT line FROM worded WHERE has_word GROUP BY line HAVING count(DISTINCT source) >= 5),
hits AS (SELECT w.* FROM worded w JOIN widespread USING (line) WHERE w.has_word),
voters AS (
  SELECT doc_id, text FROM (SELECT DISTINCT doc_id, text, position, line FROM hits) GROUP BY doc_id, text
  HAVING sum(length(line)) <= 0.8 * length(text)
), boilerplate AS (
  SELECT h.line FROM hits h JOIN voters v ON h.doc_id IS NOT DISTINCT FROM v.doc_id AND h.text = v.text GROUP BY h.line HAVING count(DISTINCT h.source) >= 5
), marked AS (
  SELECT w.doc_id, w.text, w.line, w.position, w.has_word, b.line IS NOT NULL AS hit
  FROM worded w LEFT JOIN boilerplate b ON w.line = b.line AND w.has_word
), per_doc AS (
  SELECT doc_id, count(*) FILTER (has_word) AS n_lines, count(*) FILTER (hit) AS hits,
         coalesce(sum(length(line)) FILTER (hit), 0) AS hit_chars,
         coalesce(string_agg(line, chr(10) ORDER BY position) FILTER (NOT hit), '') AS rest
  FROM marked GROUP BY doc_id
)
SELECT d.doc_id, coalesce(j.n_lines, 0)::BIGINT AS n_lines, coalesce(j.hits, 0)::BIGINT AS n_removed,
       coalesce(j.hit_chars, 0)::BIGINT AS removed_chars, CASE WHEN j.hits > 0 THEN j.rest ELSE d.text END AS text
FROM documents d LEFT JOIN per_doc j USING (doc_id)
""",
    "op11_source_divergence": r"""
WITH rows AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS words
  FROM documents
), each AS (SELECT r, lang, source, unnest(words) AS term FROM rows),
kept AS (SELECT lang, term FROM each GROUP BY lang, term HAVING count(DISTINCT r) >= 10),
sizes AS (SELECT lang, count(*)::HUGEINT AS v FROM kept GROUP BY lang),
in_group AS (SELECT lang, source, term, count(*)::HUGEINT AS n FROM each JOIN kept USING (lang, term) GROUP BY lang, source, term),
in_lang AS (SELECT lang, term, sum(n)::HUGEINT AS n FROM in_group GROUP BY lang, term),
groups AS (SELECT DISTINCT lang, source FROM rows),
totals AS (SELECT lang, source, coalesce(sum(n), 0)::HUGEINT AS total FROM groups LEFT JOIN in_group USING (lang, source) GROUP BY lang, source),
lang_totals AS (SELECT lang, sum(n)::HUGEINT AS total FROM in_lang GROUP BY lang),
p AS (
  SELECT t.lang, t.source, k.term, coalesce(g.n, 0) AS n, 1 + 1000000000::HUGEINT * (coalesce(g.n, 0) + 2) // (t.total + 2 * s.v) AS p
  FROM totals t JOIN kept k ON k.lang = t.lang JOIN sizes s ON s.lang = t.lang
  LEFT JOIN in_group g ON g.lang = t.lang AND g.source = t.source AND g.term = k.term
), pairs AS (
  SELECT x.lang, x.source, y.source AS item, sum((x.p - y.p) * (x.p - y.p) // (x.p + y.p)) AS value
  FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY x.lang, x.source, y.source
), all_pairs AS (
  SELECT a.lang, a.source, b.source AS item, coalesce(pairs.value, 0)::BIGINT AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pairs ON pairs.lang = a.lang AND pairs.source = a.source AND pairs.item = b.source
), terms AS (
  SELECT p.lang, p.source, p.term AS item, ((p.p - q.q) * (p.p - q.q) // (p.p + q.q))::BIGINT AS value
  FROM p JOIN (SELECT lang, term, 1 + 1000000000::HUGEINT * (n + 2) // (total + 2 * v) AS q FROM in_lang JOIN lang_totals USING (lang) JOIN sizes USING (lang)) q USING (lang, term)
  WHERE p.n > 0 AND p.p > q.q
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank
  FROM (SELECT lang, source, 'pair' AS part, item, value FROM all_pairs UNION ALL SELECT lang, source, 'term', item, value FROM terms)
)
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 10
""",
}
