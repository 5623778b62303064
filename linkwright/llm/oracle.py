"""DuckDB SQL for the queries of the subpackage that SQL can express."""

MIXING = """
WITH RECURSIVE counts AS (SELECT source, ceil(count(*) / 8)::BIGINT AS blocks, round(pow(count(*)::DOUBLE, 0.8), 6) AS t FROM documents GROUP BY source),
plan AS (SELECT source, blocks, greatest(1, round(t / sum(t) OVER () * 1000000000)::BIGINT) AS w, row_number() OVER (ORDER BY source NULLS FIRST) AS i FROM counts),
one AS (SELECT list(w ORDER BY i) AS w, sum(w)::BIGINT AS total FROM plan),
length AS (SELECT min(((blocks + 1) * total + w - 1) // w) AS slots FROM plan, (SELECT total FROM one)),
run AS (
  SELECT 0::BIGINT AS slot, list_transform(w, lambda x: 0::BIGINT) AS done, NULL::BIGINT AS pick FROM one
  UNION ALL
  SELECT slot + 1, list_transform(done, lambda d, k: d + CASE WHEN k = p THEN 1 ELSE 0 END), p FROM (
    SELECT slot, done, (
      SELECT k FROM (SELECT unnest(range(1, len(one.w) + 1)) AS k) WHERE done[k] * one.total < (slot + 1) * one.w[k]
      ORDER BY ((done[k] + 1) * one.total + one.w[k] - 1) // one.w[k], k LIMIT 1) AS p
    FROM run, one, length WHERE slot < length.slots)),
runs AS (SELECT pick AS i, row_number() OVER (PARTITION BY pick ORDER BY slot) - 1 AS block, slot - 1 AS slot FROM run WHERE pick IS NOT NULL),
finish AS (SELECT min(slot) AS last FROM runs JOIN plan USING (i) WHERE block >= blocks),
placed AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5(coalesce(doc_id::VARCHAR, '')), doc_id) - 1 AS rank FROM documents),
dealt AS (SELECT d.doc_id, d.source, d.rank // 8 AS block, d.rank % 8 AS place, p.i, p.w FROM placed d JOIN plan p ON p.source IS NOT DISTINCT FROM d.source)
SELECT d.doc_id, d.source, d.block, d.place, ((d.block + 1) * (SELECT total FROM one) + d.w - 1) // d.w AS due, r.slot, r.slot IS NOT NULL AS in_mix
FROM dealt d LEFT JOIN (SELECT * FROM runs WHERE slot < (SELECT last FROM finish)) r ON r.i = d.i AND r.block = d.block
"""

WARC = """
WITH d AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
b AS (SELECT *, list_transform(range(1, 41, 10), lambda i: ('0x' || h[i:i + 9])::BIGINT) AS parts FROM d),
e AS (SELECT *, list_aggregate(list_transform(parts, lambda n: list_aggregate(list_transform(range(7, -1, -1), lambda k: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[((n >> (5 * k)) & 31) + 1]), 'string_agg', '')), 'string_agg', '') AS digest,
             min(page_id) OVER (PARTITION BY h) AS first FROM b)
SELECT page_id, strlen(html) AS payload_bytes, digest AS payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to FROM e
"""

NEAR = """
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN w ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS s FROM w),
c AS (SELECT list_sort(s) AS s, min(doc_id) AS doc_id FROM s WHERE len(s) > 0 GROUP BY 1),
e AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM c),
links AS (SELECT a.doc_id AS x, b.doc_id AS y FROM e a JOIN e b ON a.g = b.g AND a.doc_id > b.doc_id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
          GROUP BY 1, 2 HAVING 100 * count(*) >= 80 * (any_value(a.n) + any_value(b.n) - count(*))),
sym AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach AS (SELECT doc_id AS node, doc_id AS seen FROM c UNION SELECT r.node, b.y FROM reach r JOIN sym b ON b.x = r.seen),
part AS (SELECT node, min(seen) AS component FROM reach GROUP BY node)
SELECT s.doc_id, len(s.s) AS n_shingles, coalesce(p.component, s.doc_id) AS component_id, s.doc_id = coalesce(p.component, s.doc_id) AS kept
FROM s LEFT JOIN c ON list_sort(s.s) = c.s AND len(s.s) > 0 LEFT JOIN part p ON p.node = c.doc_id
"""

SQL = {"op8_near_duplicates": NEAR, "op7_warc": WARC, "op2_mixing": MIXING}
