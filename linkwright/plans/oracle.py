"""DuckDB SQL of the catalogue: one prelude of common table expressions, and a final SELECT for each query."""

from __future__ import annotations

from linkwright.functions import text as T

LETTERS = "abcdefghijklmnopqrstuvwxyz0123456789"


def quoted(words) -> str:
    return ", ".join(f"'{w}'" for w in words)


def normal(c: str) -> str:
    c = f"coalesce({c}, '')"
    for wide, plain in T.WIDE.items():
        c = f"replace({c}, '{wide}', '{plain}')"
    c = f"regexp_replace(replace(lower(strip_accents({c})), '&', ' and '), '[^a-z0-9]+', ' ', 'g')"
    for _ in range(2):
        c = rf"regexp_replace({c}, '([a-z])0([a-z])', '\1o\2', 'g')"
    c = rf"regexp_replace({c}, '\b([0-9]+)(?:st|nd|rd|th)\b', '\1', 'g')"
    return rf"trim(regexp_replace(regexp_replace({c}, '([0-9])([a-z])', '\1 \2', 'g'), '([a-z])([0-9])', '\1 \2', 'g'))"


def words(c: str) -> str:
    return f"CASE WHEN {c} = '' THEN []::VARCHAR[] ELSE string_split({c}, ' ') END"


def skeleton(c: str) -> str:
    for pattern, to in T.PHONETIC:
        pattern, to = ("c([eiy])", r"s\1") if pattern == "c(?=[eiy])" else (pattern, to)
        c = f"regexp_replace({c}, '{pattern}', '{to}', 'g')"
    for x in LETTERS:
        c = f"regexp_replace({c}, '{x}+', '{x}', 'g')"
    return c


def skeletons(tokens: str) -> str:
    return f"CASE WHEN len({tokens}) = 0 THEN []::VARCHAR[] ELSE string_split({skeleton(f"array_to_string({tokens}, ' ')")}, ' ') END"


def case(x: str, table: dict, other: str | None = None, quote: bool = True) -> str:
    value = (lambda v: f"'{v}'") if quote else str
    return f"CASE {x} {' '.join(f"WHEN '{k}' THEN {value(v)}" for k, v in table.items())} ELSE {other or x} END"


def clean(c: str) -> str:
    return rf"trim(regexp_replace(regexp_replace(lower(coalesce({c}, '')), '[^a-z0-9\s]', ' ', 'g'), '\s+', ' ', 'g'))"


def expand(c: str) -> str:
    for short, full in T.ABBREVIATIONS.items():
        c = rf"regexp_replace({c}, '\b{short}\b', '{full}', 'g')"
    return c


def number_at(i: str) -> str:
    return f"(CASE WHEN {i} BETWEEN 1 AND len(at_) THEN at_[{i}] END)"


def unit(x: str) -> str:
    return f"(CASE WHEN {case(x, {k: v for k, v in T.SMALL.items() if v < 10}, 'NULL', False)} IS NOT NULL THEN {case(x, {k: v for k, v in T.SMALL.items() if v < 10}, 'NULL', False)} END)"


def ten(x: str) -> str:
    return f"({case(x, T.TENS, 'NULL', False)})"


SEQUENCE = f"""list_filter(list_transform(at_, lambda x, i: coalesce(
  CASE WHEN regexp_full_match(x, '[0-9]+') AND len(x) <= 12 THEN x::BIGINT END,
  {ten('x')} + coalesce({unit(number_at('i + 1'))}, 0),
  CASE WHEN NOT ({ten(number_at('i - 1'))} IS NOT NULL AND {unit('x')} IS NOT NULL) AND x NOT IN ({quoted(T.PLAIN_WORDS)}) THEN {case('x', T.SMALL, 'NULL', False)} END)::BIGINT), lambda v: v IS NOT NULL)"""
DIGITS, ZEROS = "regexp_full_match({}, '[0-9]+')", "CASE WHEN ltrim({0}, '0') = '' THEN '0' ELSE ltrim({0}, '0') END"


def number(x: str) -> str:
    return DIGITS.format(x)


def no_zeros(x: str) -> str:
    return ZEROS.format(x)


def weights(name: str, where: str, idf: str, source: str = "feat") -> str:
    return f"{name} AS (SELECT f.entity_id, f.country, f.feature, i.idf / sqrt(sum(i.idf * i.idf) OVER (PARTITION BY f.entity_id)) AS w FROM {source} f JOIN {idf} i USING (country, feature) WHERE {where})"


def index(n: str, where: str, least: float, source: str = "feat") -> str:
    return f"""df{n} AS (SELECT country, feature, count(*) AS df FROM {source} WHERE {where} GROUP BY ALL),
n{n} AS (SELECT country, count(*) AS n FROM bag WHERE {where} GROUP BY ALL),
idf{n} AS (SELECT country, feature, ln(n / (1 + df)) AS idf FROM df{n} JOIN n{n} USING (country) WHERE ln(n / (1 + df)) >= {least})"""


def top(name: str, queries: str, postings: str, k: int, q: str = "query", c: str = "candidate", s: str = "score", r: str = "rank", where: str = "true") -> str:
    return f"""{name}_s AS (SELECT q.entity_id AS {q}, p.entity_id AS {c}, round(sum(q.w * p.w), 9) AS {s} FROM {queries} q JOIN {postings} p USING (country, feature) WHERE {where} GROUP BY 1, 2 HAVING round(sum(q.w * p.w), 9) > 0),
{name} AS (SELECT *, row_number() OVER (PARTITION BY {q} ORDER BY {s} DESC, {c}) AS {r} FROM {name}_s QUALIFY {r} <= {k})"""


def prelude(s) -> str:
    """``s``: the settings of the linkage."""
    pair_address = {k: v for k, v in T.ADDRESS_PAIR.items()}
    return f"""
toks AS (SELECT doc_id, lang, n_chars, coalesce(text, '') AS text, list_filter(string_split_regex(coalesce(text, ''), '\\s+'), lambda x: x <> '') AS t FROM documents),
clus AS (SELECT *, min(doc_id) OVER (PARTITION BY lang, substr(text, 1, 50)) AS rep, count(*) OVER (PARTITION BY lang, substr(text, 1, 50)) AS size FROM toks),
own AS (SELECT *, CASE WHEN doc_id = rep AND NOT (size > 1 AND rep % 5 = 0) THEN 'S1' WHEN doc_id % 2 = 0 THEN 'S2' ELSE 'S3' END AS src FROM clus),
rec AS (SELECT src || '-' || doc_id AS entity_id, src, lang AS country, array_to_string(t[1:4], ' ') AS business_name, n_chars || ' ' || array_to_string(t[5:12], ' ') AS business_address, doc_id, rep FROM own),
truth AS (SELECT a.entity_id AS source1_entity_id, b.entity_id AS candidate_entity_id FROM rec a JOIN rec b ON b.rep = a.doc_id AND a.src = 'S1' AND b.src <> 'S1'),
ents AS (SELECT entity_id, count(candidate_entity_id) AS n_true FROM rec LEFT JOIN truth ON entity_id = source1_entity_id WHERE src = 'S1' GROUP BY 1),
nrm AS (SELECT *, {normal('business_name')} AS nm, {normal('business_address')} AS ad FROM rec),
tok AS (SELECT *, {words('nm')} AS nt, {words('ad')} AS a0 FROM nrm),
b1 AS (SELECT *, list_filter(nt, lambda x: x NOT IN ({quoted(T.NAME_STOP)})) AS n, list_transform(list_transform(a0, lambda x: {case('x', T.NUMBER_WORDS)}), lambda x: {case('x', T.ADDRESS)}) AS a FROM tok),
b2 AS (SELECT *, {skeletons('n')} AS kn, list_filter(a, lambda x: NOT {number('x')} AND len(x) >= 3) AS wa FROM b1),
b3 AS (SELECT *, {skeletons('wa')} AS kw FROM b2),
bag AS (SELECT entity_id, src, country, list_distinct(list_concat(
  list_transform(list_filter(n, lambda x: len(x) >= 2), lambda x: 'n_' || x), list_transform(list_filter(kn, lambda x: len(x) >= 3), lambda x: 'k_' || x),
  list_transform(range(1, len(n)), lambda i: 'b_' || n[i] || '_' || n[i + 1]), list_transform(list_filter(a, lambda x: {number('x')}), lambda x: 'd_' || {no_zeros('x')}),
  list_filter(list_transform(a, lambda x, i: CASE WHEN {number('x')} AND i < len(a) AND NOT {number('a[i + 1]')} THEN 'dw_' || {no_zeros('x')} || '_' || a[i + 1] END), lambda x: x IS NOT NULL),
  list_transform(wa, lambda x: 'a_' || x), list_transform(list_filter(kw, lambda x: len(x) >= 3), lambda x: 'ak_' || x))) AS bag FROM b3),
feat AS (SELECT entity_id, src, country, unnest(bag) AS feature FROM bag),
{index('23', "src <> 'S1'", s.min_idf)},
{index('1', "src = 'S1'", s.min_idf)},
{weights('w23', "f.src <> 'S1'", 'idf23')}, {weights('q1', "f.src = 'S1'", 'idf23')}, {weights('w1', "f.src = 'S1'", 'idf1')}, {weights('q23', "f.src <> 'S1'", 'idf1')},
{top('fwd', 'q1', 'w23', s.top_k, 'source1_entity_id', 'candidate_entity_id')},
{top('rev', 'q23', 'w1', s.reverse_k, 'b', 's1', 'rscore', 'rrank')},
revsum AS (SELECT b, coalesce(max(rscore) FILTER (rrank = 1), 0) AS rev_best, coalesce(max(rscore) FILTER (rrank = 2), 0) AS rev_second FROM rev GROUP BY 1),
united AS (SELECT source1_entity_id, candidate_entity_id, max(score) AS score, max(fwd) AS fwd FROM (
  SELECT source1_entity_id, candidate_entity_id, score, 1 AS fwd FROM fwd UNION ALL SELECT s1, b, 0, 0 FROM rev) GROUP BY ALL),
anch0 AS (SELECT u.*, (r.b IS NOT NULL)::INT AS own, row_number() OVER (PARTITION BY source1_entity_id ORDER BY score DESC, candidate_entity_id) AS rk
  FROM united u LEFT JOIN rev r ON r.s1 = u.source1_entity_id AND r.b = u.candidate_entity_id AND r.rrank = 1),
anch AS (SELECT source1_entity_id, candidate_entity_id, score, fwd, CASE WHEN (rk <= 3 OR own = 1) AND row_number() OVER (PARTITION BY source1_entity_id
  ORDER BY (rk <= 3 OR own = 1)::INT DESC, own DESC, score DESC, candidate_entity_id) <= {s.n_anchor} THEN 1.0 ELSE 0.0 END::DOUBLE AS is_anchor FROM anch0),
asked AS (SELECT w.* FROM w23 w WHERE entity_id IN (SELECT candidate_entity_id FROM anch WHERE is_anchor = 1)),
{top('sib', 'asked', 'w23', s.siblings + 1)},
edges AS (SELECT a.source1_entity_id, a.candidate_entity_id AS anchor, s.candidate AS candidate_entity_id, s.score AS nscore FROM anch a JOIN sib s ON s.query = a.candidate_entity_id WHERE a.is_anchor = 1 AND s.query <> s.candidate),
sibs AS (SELECT source1_entity_id, candidate_entity_id, count(DISTINCT anchor) AS sib_n, max(nscore) AS sib_best FROM edges GROUP BY ALL),
expd AS (SELECT source1_entity_id, candidate_entity_id, coalesce(score, 0)::DOUBLE AS score, coalesce(fwd, 0)::INT AS fwd, coalesce(is_anchor, 0)::DOUBLE AS is_anchor, coalesce(sib_n, 0)::BIGINT AS sib_n, coalesce(sib_best, 0)::DOUBLE AS sib_best
  FROM anch FULL JOIN sibs USING (source1_entity_id, candidate_entity_id)),
ctx0 AS (SELECT e.*, row_number() OVER w AS rank, max(score) OVER (PARTITION BY e.source1_entity_id) AS best, coalesce(r.rscore, 0) AS rscore, coalesce(r.rrank, {s.reverse_k + 1}) AS rev_rank,
  coalesce(rev_best, 0) AS rev_best, coalesce(rev_second, 0) AS rev_second FROM expd e LEFT JOIN rev r ON r.s1 = e.source1_entity_id AND r.b = e.candidate_entity_id LEFT JOIN revsum v ON v.b = e.candidate_entity_id
  WINDOW w AS (PARTITION BY e.source1_entity_id ORDER BY score DESC, e.candidate_entity_id)),
ctx AS (SELECT *, CASE WHEN best > 0 THEN score / best ELSE 0 END AS score_rel, best - score AS score_gap_best, CASE WHEN rev_best > 0 THEN rscore / rev_best ELSE 0 END AS rev_score_rel, rev_best - rscore AS rev_gap,
  rev_best - rev_second AS rev_margin, (rev_rank = 1)::INT AS rev_is_best, sum((rev_rank = 1)::INT) OVER (PARTITION BY source1_entity_id) AS a_n_revbest FROM ctx0),
prep0 AS (SELECT entity_id, country, business_name, business_address, nt, list_transform(a0, lambda x: {case('x', pair_address)}) AS at_, list_filter(nt, lambda x: x NOT IN ({quoted(T.LEGAL)})) AS core FROM tok),
prep AS (SELECT *, list_distinct(list_transform(list_filter(at_, lambda x: {number('x')}), lambda x: {no_zeros('x')})) AS nums, list_distinct(core) AS core_set, list_distinct(at_) AS addr_set, array_to_string(nt, ' ') AS name,
  array_to_string(core, '') AS concat, CASE WHEN len(core) >= 2 THEN array_to_string(list_transform(core, lambda x: x[1]), '') ELSE '' END AS initials, {SEQUENCE} AS seq FROM prep0),
pairs AS (SELECT f.source1_entity_id, f.candidate_entity_id, f.score, f.rank, a, b FROM fwd f JOIN prep a ON a.entity_id = source1_entity_id JOIN prep b ON b.entity_id = candidate_entity_id),
tw AS (SELECT entity_id, 'name' AS side, t AS token, country, 'n_' || t AS feature FROM (SELECT entity_id, country, unnest(list_distinct(list_filter(nt, lambda x: x NOT IN ({quoted(T.NAME_STOP)}) AND len(x) >= 2))) AS t FROM prep)
  UNION ALL SELECT entity_id, 'addr', f, country, f FROM (SELECT entity_id, country, unnest(list_distinct(list_filter(list_transform(list_transform(list_transform(at_, lambda x: {case('x', T.NUMBER_WORDS)}), lambda x: {case('x', T.ADDRESS)}),
    lambda x: CASE WHEN {number('x')} THEN 'd_' || {no_zeros('x')} WHEN len(x) >= 3 THEN 'a_' || x END), lambda x: x IS NOT NULL))) AS f FROM prep)),
tww AS (SELECT entity_id, side, token, coalesce(idf, 0) AS w FROM tw LEFT JOIN idf23 USING (country, feature)),
lab AS (SELECT f.source1_entity_id, f.candidate_entity_id, least(1.0, score) AS p, (t.source1_entity_id IS NOT NULL)::INT AS label FROM fwd f LEFT JOIN truth t USING (source1_entity_id, candidate_entity_id)),
lists AS (SELECT r.entity_id, coalesce(l.ids, '') AS ids FROM rec r LEFT JOIN (SELECT source1_entity_id, string_agg(candidate_entity_id, ',' ORDER BY p DESC, candidate_entity_id) AS ids FROM lab GROUP BY 1) l ON r.entity_id = l.source1_entity_id WHERE src = 'S1'),
bad AS (SELECT entity_id, CASE doc_id % 11 WHEN 0 THEN ids || ',' || ids WHEN 1 THEN 'S1-1,' || ids WHEN 2 THEN 'X9-1' WHEN 3 THEN 'S2-999999999' ELSE ids END AS ids FROM lists JOIN rec USING (entity_id) WHERE doc_id % 11 <> 4
  UNION ALL SELECT entity_id, ids FROM lists JOIN rec USING (entity_id) WHERE doc_id % 11 = 5 UNION ALL SELECT 'S1-x' || doc_id, '' FROM rec WHERE src = 'S1' AND doc_id % 11 = 6),
badids AS (SELECT entity_id, unnest(list_filter(string_split(ids, ','), lambda x: x <> '')) AS id FROM bad)"""


def first_normal(c: str) -> str:
    c = f"coalesce({c}, '')"
    for wide, plain in T.WIDE.items():
        c = f"replace({c}, '{wide}', '{plain}')"
    return f"trim(regexp_replace(replace(lower(strip_accents({c})), '&', ' and '), '[^a-z0-9]+', ' ', 'g'))"


def first_skeletons(tokens: str) -> str:
    c = f"regexp_replace(array_to_string({tokens}, ' '), '[aeiouyh]', '', 'g')"
    for x in LETTERS:
        c = f"regexp_replace({c}, '{x}+', '{x}', 'g')"
    return f"CASE WHEN len({tokens}) = 0 THEN []::VARCHAR[] ELSE string_split({c}, ' ') END"


def variant(i: int, first: bool = False, skeleton: tuple[str, ...] = ("v2",), concat: bool = False, address_skeletons: bool = True) -> str:
    """Table expressions up to vf{i}, the features of a variant of the bag."""
    mapped = case("x", T.ADDRESS)
    address = f"list_transform(a0, lambda x: {mapped})" if first else f"list_transform(list_transform(a0, lambda x: {case('x', T.NUMBER_WORDS)}), lambda x: {mapped})"
    zeros = (lambda x: x) if first else no_zeros
    parts = ["list_transform(list_filter(n, lambda x: len(x) >= 2), lambda x: 'n_' || x)", "list_transform(range(1, len(n)), lambda i: 'b_' || n[i] || '_' || n[i + 1])"]
    parts += [f"list_transform(list_filter({own}, lambda x: len(x) >= 3), lambda x: '{tag}' || x)" for v, own, tag in (("v1", "k1", "k1_"), ("v2", "k2", "k_")) if v in skeleton]
    if concat:
        parts.append("list_transform(list_filter(n, lambda x: len(x) >= 8), lambda x: 'c_' || x)")
        parts += [f"CASE WHEN len(n) >= {k} THEN ['c_' || array_to_string(n[1:{k}], '')] ELSE []::VARCHAR[] END" for k in (2, 3)]
    parts += [
        f"list_transform(list_filter(a, lambda x: {number('x')}), lambda x: 'd_' || {zeros('x')})", "list_transform(wa, lambda x: 'a_' || x)",
        f"list_filter(list_transform(a, lambda x, i: CASE WHEN {number('x')} AND i < len(a) AND NOT {number('a[i + 1]')} THEN 'dw_' || {zeros('x')} || '_' || a[i + 1] END), lambda x: x IS NOT NULL)",
    ]
    if address_skeletons:
        parts.append("list_transform(list_filter(kw, lambda x: len(x) >= 3), lambda x: 'ak_' || x)")
    text = (first_normal if first else normal)
    bag = parts[0]
    for p in parts[1:]:
        bag = f"list_concat({bag}, {p})"
    return f"""va{i} AS (SELECT entity_id, src, country, {text('business_name')} AS nm, {text('business_address')} AS ad FROM rec),
vt{i} AS (SELECT *, list_filter({words('nm')}, lambda x: x NOT IN ({quoted(T.NAME_STOP)})) AS n, {words('ad')} AS a0 FROM va{i}),
vb{i} AS (SELECT *, {address} AS a FROM vt{i}),
vc{i} AS (SELECT *, {first_skeletons('n')} AS k1, {skeletons('n')} AS k2, list_filter(a, lambda x: NOT {number('x')} AND len(x) >= 3) AS wa FROM vb{i}),
vd{i} AS (SELECT *, {skeletons('wa')} AS kw FROM vc{i}),
vf{i} AS (SELECT entity_id, src, country, unnest(list_distinct({bag})) AS feature FROM vd{i})"""


def found(i: str, source: str, least: float, k: int) -> str:
    """Table expressions up to fo{i}, the k best pairs by the features of ``source``."""
    own = f"x{i}"
    return ",\n".join([index(own, "src <> 'S1'", least, source), weights(f"{own}p", "f.src <> 'S1'", f"idf{own}", source), weights(f"{own}q", "f.src = 'S1'", f"idf{own}", source), top(f"fo{i}", f"{own}q", f"{own}p", k, "source1_entity_id", "candidate_entity_id")])


def ablation(variants: dict[str, tuple[dict, bool]], least: float, k: int) -> tuple[str, str]:
    """(the final SELECT, further table expressions) of the recall of each variant's k best pairs."""
    tables, selects = [], []
    for i, (name, (options, views)) in enumerate(variants.items()):
        tables += [variant(i, **options), found(str(i), f"vf{i}", least, k // 2 if views else k)]
        sets = [f"fo{i}"]
        for side, prefixes in (("n", ("n", "k", "k1", "b", "c")), ("a", ("d", "dw", "a", "ak"))) if views else ():
            tables += [f"vw{i}{side} AS (SELECT * FROM vf{i} WHERE split_part(feature, '_', 1) IN ({quoted(prefixes)}))", found(f"{i}{side}", f"vw{i}{side}", least, k // 4)]
            sets.append(f"fo{i}{side}")
        pairs = f"({' UNION '.join(f'SELECT source1_entity_id, candidate_entity_id FROM {x}' for x in sets)})"
        hits = f"SELECT count(*) FROM truth JOIN {pairs} USING (source1_entity_id, candidate_entity_id)"
        selects.append(f"SELECT '{name}' AS variant, round(({hits}) / (SELECT count(*) FROM truth), 6) AS recall, (SELECT count(*) FROM {pairs}) AS pairs")
    return "\nUNION ALL ".join(selects), ",\n".join(tables)


def kernel_tables(source: str) -> str:
    """Table expressions up to ker (kind, ka, kb, ratio, tset, tsort, part) for the rows of ``source`` (kind, a, b).

    Every longest common subsequence that is asked for is found once, with a row of its table in the bits of one number.
    """
    sets = "list_sort(list_distinct({}))"
    ratio = lambda x, y, n: f"CASE WHEN len({x}) + len({y}) = 0 THEN 100 ELSE 200::DOUBLE * {n} / (len({x}) + len({y})) END"
    window = "substr({0}, greatest(0, s) + 1, s + len({1}) - greatest(0, s))"
    return f"""sd AS (SELECT DISTINCT kind, a, b FROM {source}),
sw AS (SELECT *, list_filter(string_split(a, ' '), lambda x: x <> '') AS ta, list_filter(string_split(b, ' '), lambda x: x <> '') AS tb FROM sd),
sp AS (SELECT kind, a, b, len(ta) > 0 AND len(tb) > 0 AS both_, array_to_string(list_sort(ta), ' ') AS oa, array_to_string(list_sort(tb), ' ') AS ob,
  array_to_string({sets.format('list_intersect(ta, tb)')}, ' ') AS x0, array_to_string({sets.format('list_filter(ta, lambda x: NOT list_contains(tb, x))')}, ' ') AS xa,
  array_to_string({sets.format('list_filter(tb, lambda x: NOT list_contains(ta, x))')}, ' ') AS xb FROM sw),
sf AS (SELECT *, trim(x0 || ' ' || xa) AS fa, trim(x0 || ' ' || xb) AS fb FROM sp),
win AS (SELECT DISTINCT kind, a, b, a AS s1, {window.format('b', 'a')} AS s2 FROM (SELECT *, unnest(range(1 - len(a), len(b))) AS s FROM sd WHERE a <> '' AND b <> '' AND len(a) <= len(b))
  UNION SELECT DISTINCT kind, a, b, b, {window.format('a', 'b')} FROM (SELECT *, unnest(range(1 - len(b), len(a))) AS s FROM sd WHERE a <> '' AND b <> '' AND len(b) <= len(a))),
kneed AS (SELECT a AS x, b AS y FROM sf UNION SELECT oa, ob FROM sf UNION SELECT fa, fb FROM sf UNION SELECT x0, fa FROM sf UNION SELECT x0, fb FROM sf UNION SELECT s1, s2 FROM win),
turned AS (SELECT x, y, CASE WHEN len(x) <= len(y) THEN x ELSE y END AS p, CASE WHEN len(x) <= len(y) THEN y ELSE x END AS q FROM kneed),
bits AS (SELECT DISTINCT p, q, string_split(p, '') AS ps, (1::HUGEINT << len(p)::HUGEINT) - 1 AS full_ FROM turned),
lcs0 AS (SELECT p, q, CASE WHEN p = '' THEN 0 ELSE len(p) - bit_count(list_reduce(
  list_transform(string_split(q, ''), lambda c: list_sum(list_transform(ps, lambda z, i: CASE WHEN z = c THEN 1::HUGEINT << (i - 1)::HUGEINT ELSE 0::HUGEINT END))::HUGEINT),
  lambda v, k: ((v + (v & k)) | (v - (v & k))) & full_, full_)) END AS n FROM bits),
lcs AS (SELECT x, y, n FROM turned JOIN lcs0 USING (p, q)),
kbest AS (SELECT kind, a, b, max({ratio('s1', 's2', 'n')}) AS part FROM win JOIN lcs ON x = s1 AND y = s2 GROUP BY ALL),
ker AS (SELECT f.kind, f.a AS ka, f.b AS kb, {ratio('f.a', 'f.b', 'l1.n')} AS ratio, {ratio('oa', 'ob', 'l2.n')} AS tsort,
  CASE WHEN NOT both_ THEN 0 WHEN x0 <> '' AND (xa = '' OR xb = '') THEN 100 WHEN x0 <> '' THEN greatest({ratio('fa', 'fb', 'l3.n')}, {ratio('x0', 'fa', 'l4.n')}, {ratio('x0', 'fb', 'l5.n')}) ELSE {ratio('fa', 'fb', 'l3.n')} END AS tset,
  CASE WHEN f.a = '' AND f.b = '' THEN 100 ELSE coalesce(part, 0) END AS part
  FROM sf f JOIN lcs l1 ON l1.x = f.a AND l1.y = f.b JOIN lcs l2 ON l2.x = oa AND l2.y = ob JOIN lcs l3 ON l3.x = fa AND l3.y = fb JOIN lcs l4 ON l4.x = x0 AND l4.y = fa JOIN lcs l5 ON l5.x = x0 AND l5.y = fb
  LEFT JOIN kbest USING (kind, a, b))"""


def one_to_one(source: str, keys: str = "") -> str:
    return f"(SELECT * FROM {source} QUALIFY row_number() OVER (PARTITION BY {keys} candidate_entity_id ORDER BY p DESC, source1_entity_id) = 1)"


def threshold_rule(source: str, threshold: str, rel: str, keys: str = "") -> str:
    cut = f"(SELECT * FROM {source} QUALIFY p >= {threshold} AND p >= {rel} * max(p) OVER (PARTITION BY {keys} source1_entity_id))"
    return f"(SELECT * FROM {one_to_one(cut, keys)} QUALIFY row_number() OVER (PARTITION BY {keys} source1_entity_id ORDER BY p DESC, candidate_entity_id) <= 10)"


def expected_rule(source: str, miss: str, power: str, keys: str = "") -> str:
    q = f"(SELECT *, pow(greatest(1e-6, least(1 - 1e-6, p)), {power}) AS q FROM {one_to_one(f'(SELECT * FROM {source} WHERE p >= 0.02)', keys)})"
    e = f"""(SELECT *, row_number() OVER o AS k, sum(q) OVER (o ROWS UNBOUNDED PRECEDING) AS cum, sum(q) OVER g AS al, exp(sum(ln(1 - q)) OVER g) AS none FROM {q}
  WINDOW o AS (PARTITION BY {keys} source1_entity_id ORDER BY q DESC, candidate_entity_id), g AS (PARTITION BY {keys} source1_entity_id))"""
    f = f"(SELECT *, round(1.25 * cum / (k + 0.25 * (al + {miss})), 12) AS ef FROM {e})"
    t = f"(SELECT *, max(ef) OVER (PARTITION BY {keys} source1_entity_id) AS top FROM {f})"
    return f"(SELECT * FROM (SELECT *, min(CASE WHEN ef = top THEN k END) OVER (PARTITION BY {keys} source1_entity_id) AS last FROM {t}) WHERE k <= last AND top > none)"


def f05(kept: str, keys: tuple[str, ...] = (), grid: str = "") -> str:
    names = "".join(f"{k}, " for k in keys)
    using = ", ".join([*keys, "entity_id"])
    return f"""SELECT {names} round(avg(CASE WHEN n_true = 0 AND coalesce(n, 0) = 0 THEN 1 WHEN coalesce(tp, 0) = 0 THEN 0 ELSE 1.25 * (tp / n) * (tp / n_true) / (0.25 * tp / n + tp / n_true) END), 6) AS f05
FROM (SELECT * FROM ents {f', {grid}' if grid else ''}) e LEFT JOIN (SELECT {names} source1_entity_id AS entity_id, sum(label) AS tp, count(*) AS n FROM {kept} GROUP BY ALL) k USING ({using}) {'GROUP BY ALL' if keys else ''}"""
