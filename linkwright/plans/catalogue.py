"""Every registered query with its DuckDB counterpart; all run over every row of records made of ``documents``, which hold the first twelve words of a text (README)."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkwright.functions import text as T
from linkwright.operators import bag, candidates, decide, measure, model, pairs, quality, retrieve, sampling
from linkwright.operators.similarity import kernels
from linkwright.plans import linkage, oracle
from linkwright.plans.oracle import clean, expand, expected_rule, f05, index, number, skeletons, threshold_rule, weights
from linkwright.sources import records as R

#: The documents make small indexes, so features that are not very frequent must stay.
#: They are few as well, so that leaves of few rows and some tens of rounds must do.
SETTINGS = linkage.Settings(top_k=10, min_idf=2.0, rounds=20, patience=8, least_rows=1)
TREES = {"minInstancesPerNode": SETTINGS.least_rows}
PAIR = ["source1_entity_id", "candidate_entity_id"]
PRELUDE = oracle.prelude(SETTINGS)

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None, before: str = "", keep: bool = False):
    """Registers a function of a Linkage under its name. ``sql``: the final SELECT; ``before``: further table expressions.

    ``keep``: records are romanised first, as in production. Bags, index and candidate lists are always written once.
    """

    def register(make):
        QUERIES[make.__name__] = lambda spark, sf_dir: make(linkage.documents(spark, sf_dir, SETTINGS, keep))
        if sql:
            ORACLE[make.__name__] = f"WITH {PRELUDE}{',' + before if before else ''}\n{sql}"
        return make

    return register


def six(*names: str) -> list:
    return [F.round(n, 6).alias(n) for n in names]


def six_sql(*names: str) -> str:
    return ", ".join(f"round({n}, 6) AS {n}" for n in names)


# Text.


@query(f"SELECT entity_id, {clean('business_name')} AS name_clean, {clean('business_address')} AS address_clean FROM rec")
def text_clean_v0(w) -> DataFrame:
    return w.records.select("entity_id", T.clean_text(F.col("business_name")).alias("name_clean"), T.clean_text(F.col("business_address")).alias("address_clean"))


@query(f"SELECT entity_id, {expand(clean('business_name'))} AS name_full, {expand(clean('business_address'))} AS address_full FROM rec")
def abbrev_expand(w) -> DataFrame:
    full = lambda c: T.expand_abbreviations(T.clean_text(F.col(c)))
    return w.records.select("entity_id", full("business_name").alias("name_full"), full("business_address").alias("address_full"))


@query("SELECT entity_id, nm AS name_normal, ad AS address_normal, len(nt) AS n_name, len(a0) AS n_address FROM tok")
def normalize_tokens(w) -> DataFrame:
    df = w.records.select("entity_id", T.normal_text(F.col("business_name")).alias("name_normal"), T.normal_text(F.col("business_address")).alias("address_normal"))
    return df.withColumns({"n_name": F.size(T.words(F.col("name_normal"))).cast("long"), "n_address": F.size(T.words(F.col("address_normal"))).cast("long")})


@query("SELECT entity_id, lower(strip_accents(replace(replace(replace(business_name, 'ß', 'ss'), 'œ', 'oe'), 'æ', 'ae'))) AS latin FROM rec")
def translit_latin(w) -> DataFrame:
    return w.records.select("entity_id", F.lower(T.to_latin(F.col("business_name"))).alias("latin"))


@query(f"SELECT entity_id, array_to_string({skeletons('nt')}, ' ') AS skeleton FROM tok")
def phonetic_skeleton(w) -> DataFrame:
    df = w.records.withColumn("nt", T.tokens(F.col("business_name")))
    return df.select("entity_id", F.array_join(T.skeletons(F.col("nt")), " ").alias("skeleton"))


@query("SELECT entity_id, array_to_string(a, ' ') AS address_blocking, array_to_string(at_, ' ') AS address_pair FROM b1 JOIN prep USING (entity_id)")
def addr_canon(w) -> DataFrame:
    df = w.records.withColumn("t", T.tokens(F.col("business_address")))
    blocking = T.mapped(T.mapped(F.col("t"), T.NUMBER_WORDS), T.ADDRESS)
    return df.select("entity_id", F.array_join(blocking, " ").alias("address_blocking"), F.array_join(T.mapped(F.col("t"), T.ADDRESS_PAIR), " ").alias("address_pair"))


@query("SELECT entity_id, array_to_string(core, ' ') AS core, concat, initials FROM prep")
def legal_core(w) -> DataFrame:
    return pairs.prepare(w.records).select("entity_id", F.col("core_name").alias("core"), "concat", "initials")


@query("SELECT entity_id, array_to_string(seq, ',') AS numbers FROM prep")
def number_seq(w) -> DataFrame:
    return pairs.prepare(w.records).select("entity_id", F.array_join(F.transform("seq", lambda x: x.cast("string")), ",").alias("numbers"))


@query("SELECT entity_id, CASE WHEN src = 'S3' THEN 10000000000 ELSE 0 END + doc_id AS code, CASE WHEN src <> 'S1' THEN entity_id END AS decoded FROM rec")
def id_codec(w) -> DataFrame:
    df = w.records.select("entity_id", "src", R.id_code(F.col("entity_id")).alias("code"))
    return df.select("entity_id", "code", F.when(F.col("src") != "S1", R.decode_id(F.col("code"))).alias("decoded"))


# Bags and keys.


@query("SELECT entity_id, country, feature FROM feat")
def feature_bag(w) -> DataFrame:
    return bag.features(w.records)


KEYS = f"""v0 AS (SELECT entity_id, src, {expand(clean('business_name'))} AS n, {expand(clean('business_address'))} AS a FROM rec),
v1 AS (SELECT entity_id, src, n, a, CASE WHEN n <> '' THEN string_split(n, ' ') END AS nw, CASE WHEN a <> '' THEN string_split(a, ' ') END AS aw FROM v0),
keys AS (SELECT entity_id, src, 1 AS key_no, n[1:4] || '_' || aw[1] AS key FROM v1 UNION ALL SELECT entity_id, src, 2, nw[1] || '_' || aw[-1] FROM v1 UNION ALL SELECT entity_id, src, 3, n[1:4] || '_' || a[1:4] FROM v1
  UNION ALL SELECT entity_id, src, 4, nw[-1] || '_' || aw[1] FROM v1 UNION ALL SELECT entity_id, src, 5, nw[1] || '_' || aw[1] FROM v1),
v0pairs AS (SELECT DISTINCT a.entity_id AS source1_entity_id, b.entity_id AS candidate_entity_id FROM keys a JOIN keys b USING (key_no, key) WHERE a.src = 'S1' AND b.src <> 'S1')"""


@query("SELECT entity_id, key_no, key FROM keys WHERE key IS NOT NULL", KEYS)
def blocking_keys_v0(w) -> DataFrame:
    return bag.first_generation_keys(w.records)


@query("SELECT * FROM v0pairs", KEYS)
def blocking_join_v0(w) -> DataFrame:
    return bag.first_generation_pairs(w.s1, w.s23)


@query(
    """SELECT (SELECT count(*) FROM v0pairs) AS pairs, round((SELECT avg((v.source1_entity_id IS NOT NULL)::INT) FROM truth LEFT JOIN v0pairs v USING (source1_entity_id, candidate_entity_id)), 6) AS recall,
round(1 - (SELECT count(*) FROM v0pairs) / ((SELECT count(*) FROM rec WHERE src = 'S1') * (SELECT count(*) FROM rec WHERE src <> 'S1')), 6) AS reduction""",
    KEYS,
)
def blocking_quality_v0(w) -> DataFrame:
    return measure.reduction(bag.first_generation_pairs(w.s1, w.s23), w.truth, w.s1, w.s23).select("pairs", *six("recall", "reduction"))


# Index and retrieval.


@query("SELECT country, feature, df FROM df23")
def doc_freq(w) -> DataFrame:
    return retrieve.document_frequency(w.bags23)


@query(f"SELECT country, feature, {six_sql('idf')} FROM idf23")
def idf(w) -> DataFrame:
    return w.index23[1].select("country", "feature", *six("idf"))


@query(f"SELECT entity_id, country, feature, {six_sql('w')} FROM w23")
def unit_weights(w) -> DataFrame:
    return w.index23[0].select("entity_id", "country", "feature", *six("w"))


@query("SELECT source1_entity_id, candidate_entity_id, score, rank FROM fwd")
def topk_forward(w) -> DataFrame:
    return w.forward


@query("SELECT b, s1, rscore, rrank FROM rev")
def topk_reverse(w) -> DataFrame:
    return w.reverse


@query("SELECT b, rev_best, rev_second FROM revsum")
def reverse_summary(w) -> DataFrame:
    return retrieve.reverse_summary(w.reverse)


@query(
    """SELECT share, count(*) AS pairs, round(sum((t.source1_entity_id IS NOT NULL)::INT) / (SELECT count(*) FROM truth), 6) AS recall
FROM (SELECT f.*, max(score) OVER (PARTITION BY source1_entity_id) AS best FROM fwd f) f JOIN (SELECT unnest([0.3, 0.4, 0.5, 0.6])::DOUBLE AS share) g ON score >= share * best
LEFT JOIN truth t USING (source1_entity_id, candidate_entity_id) GROUP BY 1""",
    keep=True,
)
def relative_cut(w) -> DataFrame:
    labelled, n = measure.label_pairs(w.forward, w.truth), w.truth.agg(F.count(F.lit(1)).alias("n"))
    out = None
    for share in (0.3, 0.4, 0.5, 0.6):
        one = retrieve.relative_cut(labelled, share).agg(F.count(F.lit(1)).alias("pairs"), F.sum("label").alias("hits")).withColumn("share", F.lit(share))
        out = one if out is None else out.unionByName(one)
    return out.crossJoin(n).select("share", "pairs", F.round(F.col("hits") / F.col("n"), 6).alias("recall"))


def _view(n: str, prefixes: tuple[str, ...], k: int) -> str:
    keep = f"split_part(feature, '_', 1) IN ({oracle.quoted(prefixes)})"
    return f"""f{n} AS (SELECT * FROM feat WHERE {keep}), {index(f'v{n}', "src <> 'S1'", SETTINGS.min_idf, f'f{n}')},
{weights(f'wv{n}', f"f.src <> 'S1' AND {keep}", f'idfv{n}')}, {weights(f'qv{n}', f"f.src = 'S1' AND {keep}", f'idfv{n}')}, {oracle.top(f'tv{n}', f'qv{n}', f'wv{n}', k)}"""


@query(
    "SELECT DISTINCT query AS source1_entity_id, candidate AS candidate_entity_id FROM (SELECT query, candidate FROM tva UNION ALL SELECT query, candidate FROM tvb UNION ALL SELECT query, candidate FROM tvc)",
    ",".join((_view("a", retrieve.NAME_VIEW + retrieve.ADDRESS_VIEW, 5), _view("b", retrieve.NAME_VIEW, 2), _view("c", retrieve.ADDRESS_VIEW, 2))),
    keep=True,
)
def multi_view(w) -> DataFrame:
    return retrieve.multi_view(w.bags1, w.bags23, 10, SETTINGS.min_idf, linkage.written)


# Candidates.


@query("SELECT * FROM united", keep=True)
def union_reverse(w) -> DataFrame:
    return w.united


@query("SELECT source1_entity_id, candidate_entity_id, is_anchor FROM anch", keep=True)
def anchors(w) -> DataFrame:
    return w.anchored.select(*PAIR, "is_anchor")


@query("SELECT * FROM edges", keep=True)
def sibling_edges(w) -> DataFrame:
    return w.edges


@query("SELECT * FROM expd", keep=True)
def sibling_expand(w) -> DataFrame:
    return w.expanded


@query(f"SELECT source1_entity_id, candidate_entity_id, {', '.join(f'round({c}::DOUBLE, 6) AS {c}' for c in candidates.CONTEXT)} FROM ctx", keep=True)
def context_features(w) -> DataFrame:
    return w.context.select(*PAIR, *[F.round(F.col(c).cast("double"), 6).alias(c) for c in candidates.CONTEXT])


# Pair features.


def _sides(w, prepared: DataFrame) -> DataFrame:
    return pairs.sides(w.forward.select(*PAIR), prepared)


def _jaccard(a: str, b: str) -> str:
    return f"CASE WHEN len({a}) + len({b}) = 0 THEN 0 ELSE len(list_intersect({a}, {b})) / len(list_distinct(list_concat({a}, {b}))) END"


CODES = "list_filter({}.nums, lambda n: len(n) BETWEEN 5 AND 6)"
CODE_A, CODE_B = CODES.format("a"), CODES.format("b")
SET_SQL = {
    "core_jacc": _jaccard("a.core_set", "b.core_set"), "name_len_a": "len(a.core_set)", "name_len_b": "len(b.core_set)", "addr_jacc": _jaccard("a.addr_set", "b.addr_set"), "num_jacc": _jaccard("a.nums", "b.nums"),
    "num_shared": "len(list_intersect(a.nums, b.nums))", "num_conflict": "(len(a.nums) > 0 AND len(b.nums) > 0 AND NOT list_has_any(a.nums, b.nums))::INT", "num_a": "len(a.nums)", "num_b": "len(b.nums)",
    "max_shared_num_len": "coalesce(list_max(list_transform(list_intersect(a.nums, b.nums), lambda x: len(x))), 0)", "postcode_match": f"list_has_any({CODE_A}, {CODE_B})::INT",
    "postcode_conflict": f"(len({CODE_A}) > 0 AND len({CODE_B}) > 0 AND NOT list_has_any({CODE_A}, {CODE_B}))::INT", "addr_empty_b": "(b.business_address = '')::INT", "addr_empty_a": "(a.business_address = '')::INT",
    "name_nonascii_b": "regexp_matches(b.business_name, '[^\\x00-\\x7F]')::INT", "is_s3": "starts_with(candidate_entity_id, 'S3-')::INT",
    "acro_ab": "(a.initials <> '' AND (list_contains(b.core_set, a.initials) OR b.concat = a.initials))::INT", "acro_ba": "(b.initials <> '' AND (list_contains(a.core_set, b.initials) OR a.concat = b.initials))::INT",
    "name_extra_a": "len(list_filter(a.core_set, lambda x: NOT list_contains(b.core_set, x)))", "name_extra_b": "len(list_filter(b.core_set, lambda x: NOT list_contains(a.core_set, x)))",
}


def _double(table: dict) -> str:
    return ", ".join(f"round(({v})::DOUBLE, 6) AS {k}" for k, v in table.items())


def _six(table: dict) -> list:
    return [F.round(v, 6).alias(k) for k, v in table.items()]


@query(f"SELECT source1_entity_id, candidate_entity_id, {_double(SET_SQL)} FROM pairs")
def set_features(w) -> DataFrame:
    return _sides(w, pairs.prepare(w.records).drop("name", "skel", "seq")).select(*PAIR, *_six(pairs.set_features(F.col("a"), F.col("b"))))


SOME, FIRST = "len(a.seq) > 0 AND len(b.seq) > 0", "a.seq[1] {} b.seq[1]"
GAPS = "list_transform(list_filter(a.seq, lambda x: NOT list_contains(b.seq, x)), lambda x: list_min(list_transform(b.seq, lambda y: abs(x - y))))"
PREFIX = "starts_with(a.seq[1]::VARCHAR, b.seq[1]::VARCHAR) OR starts_with(b.seq[1]::VARCHAR, a.seq[1]::VARCHAR)"
NUMBER_SQL = {
    "num1_eq": f"CASE WHEN {SOME} THEN ({FIRST.format('=')})::INT ELSE -1 END", "num1_diff": f"CASE WHEN {SOME} THEN least(abs({FIRST.format('-')}), 1000000) ELSE -1 END",
    "num1_prefix": f"CASE WHEN {SOME} THEN ({FIRST.format('<>')} AND ({PREFIX}))::INT ELSE 0 END", "num_near_miss": f"CASE WHEN {SOME} THEN len(list_filter({GAPS}, lambda g: g > 0 AND g <= 20)) ELSE 0 END",
    "num_min_diff": f"CASE WHEN {SOME} THEN coalesce(least(list_min({GAPS}), CASE WHEN list_min({GAPS}) IS NOT NULL THEN 1000000 END), -1) ELSE -1 END",
}


@query(f"SELECT source1_entity_id, candidate_entity_id, {_double(NUMBER_SQL)} FROM pairs")
def number_features(w) -> DataFrame:
    return _sides(w, pairs.prepare(w.records)).select(*PAIR, *_six(pairs.number_features(F.col("a"), F.col("b"))))


def _overlap(side: str) -> str:
    total = lambda e: f"coalesce((SELECT sum(w) FROM tww WHERE entity_id = {e} AND side = '{side}'), 0)"
    lone = lambda e, o: f"coalesce((SELECT max(w) FROM tww x WHERE x.entity_id = {e} AND side = '{side}' AND token NOT IN (SELECT token FROM tww y WHERE y.entity_id = {o} AND y.side = '{side}')), 0)"
    a, b = "f.source1_entity_id", "f.candidate_entity_id"
    common = f"coalesce((SELECT sum(x.w) FROM tww x JOIN tww y ON x.token = y.token AND x.side = y.side WHERE x.entity_id = {a} AND y.entity_id = {b} AND x.side = '{side}'), 0)"
    return f"{total(a)} AS ta_{side}, {total(b)} AS tb_{side}, {common} AS c_{side}, {lone(a, b)} AS {side}_w_miss_a, {lone(b, a)} AS {side}_w_miss_b"


def _shares(side: str) -> str:
    share = lambda d, n: f"round(CASE WHEN {d} > 0 THEN c_{side} / ({d}) ELSE 0 END, 6) AS {side}_w_{n}"
    return f"{share(f'ta_{side} + tb_{side} - c_{side}', 'jacc')}, {share(f'ta_{side}', 'cov_a')}, {share(f'tb_{side}', 'cov_b')}, {six_sql(f'{side}_w_miss_a', f'{side}_w_miss_b')}"


@query(f"SELECT source1_entity_id, candidate_entity_id, {_shares('name')}, {_shares('addr')} FROM (SELECT source1_entity_id, candidate_entity_id, {_overlap('name')}, {_overlap('addr')} FROM fwd f)", keep=True)
def idf_overlap(w) -> DataFrame:
    a, b = F.col("a"), F.col("b")
    return _sides(w, w.prepared).select(*PAIR, *_six(pairs.weight_features(a, b, "name") | pairs.weight_features(a, b, "addr")))


@query("SELECT source1_entity_id, candidate_entity_id, round(CASE WHEN a.name = '' AND b.name = '' THEN 1 ELSE jaro_winkler_similarity(a.name, b.name) END, 6) AS name_jw FROM pairs")
def jaro_winkler(w) -> DataFrame:
    return _sides(w, pairs.prepare(w.records)).withColumn("k", kernels(F.col("a.name"), F.col("b.name"), "jw")).select(*PAIR, F.round("k.jw", 6).alias("name_jw"))


NAMES = "strs AS (SELECT 'name' AS kind, a.name AS a, b.name AS b FROM pairs)"


@query(f"SELECT source1_entity_id, candidate_entity_id, {six_sql('ratio', 'tset', 'tsort')}, round(part, 6) AS partial FROM pairs JOIN ker k ON k.ka = a.name AND k.kb = b.name", f"{NAMES}, {oracle.kernel_tables('strs')}")
def string_ratios(w) -> DataFrame:
    df = _sides(w, pairs.prepare(w.records)).withColumn("k", kernels(F.col("a.name"), F.col("b.name"), "ratio", "tset", "tsort", "partial"))
    return df.select(*PAIR, *[F.round(f"k.{c}", 6).alias(c) for c in ("ratio", "tset", "tsort", "partial")])


#: The strings that each kind of kernel compares, of both sides, and the kernels of each kind.
KINDS = {"name": "name", "core": "core_name", "concat": "concat", "skel": "skel", "addr": "addr"}
KERNEL_SQL = {f"{kind}_{name}": f"{kind}.{'part' if name == 'partial' else name}" for kind, names in (("name", ("ratio", "tset", "tsort", "partial")), ("core", ("ratio", "tset", "partial")), ("skel", ("ratio", "tset")), ("addr", ("ratio", "tset", "partial"))) for name in names}
KERNEL_SQL |= {"core_concat_ratio": "concat.ratio", "name_jw": "CASE WHEN a.name = '' AND b.name = '' THEN 1 ELSE jaro_winkler_similarity(a.name, b.name) END"}
_whole = f"""prep2 AS (SELECT *, array_to_string(core, ' ') AS core_name, array_to_string({skeletons('core')}, ' ') AS skel, array_to_string(at_, ' ') AS addr FROM prep),
pairs2 AS (SELECT f.source1_entity_id, f.candidate_entity_id, a, b FROM fwd f JOIN prep2 a ON a.entity_id = source1_entity_id JOIN prep2 b ON b.entity_id = candidate_entity_id),
strs AS ({' UNION ALL '.join(f"SELECT '{kind}' AS kind, a.{c} AS a, b.{c} AS b FROM pairs2" for kind, c in KINDS.items())}), {oracle.kernel_tables('strs')},
over AS (SELECT source1_entity_id, candidate_entity_id, {_shares('name')}, {_shares('addr')} FROM (SELECT source1_entity_id, candidate_entity_id, {_overlap('name')}, {_overlap('addr')} FROM fwd f))"""
_joins = " ".join(f"JOIN ker {kind} ON {kind}.kind = '{kind}' AND {kind}.ka = a.{c} AND {kind}.kb = b.{c}" for kind, c in KINDS.items())
_weights = [f"{side}_w_{x}" for side in ("name", "addr") for x in ("jacc", "cov_a", "cov_b", "miss_a", "miss_b")]


@query(f"SELECT source1_entity_id, candidate_entity_id, {_double(SET_SQL | NUMBER_SQL | KERNEL_SQL)}, {', '.join(_weights)} FROM pairs2 {_joins} JOIN over USING (source1_entity_id, candidate_entity_id)", _whole, keep=True)
def pair_features(w) -> DataFrame:
    return linkage.featured(w.forward.select(*PAIR), w.prepared).select(*PAIR, *six(*pairs.STRING))


# Truth and recall.


@query("SELECT * FROM truth")
def truth_explode(w) -> DataFrame:
    lists = w.truth.groupBy("source1_entity_id").agg(F.array_join(F.collect_list("candidate_entity_id"), " , ").alias("matched_entity_ids"))
    return measure.truth_pairs(lists)


@query("SELECT f.source1_entity_id, f.candidate_entity_id, label FROM lab f")
def label_pairs(w) -> DataFrame:
    return measure.label_pairs(w.forward.select(*PAIR), w.truth)


@query(
    """SELECT k, round(avg((coalesce(rank, 1000000) <= k)::INT), 6) AS recall, any_value(pairs) AS pairs FROM (SELECT g.k, t.*, f.rank, (SELECT count(*) FROM fwd WHERE fwd.rank <= g.k) AS pairs
FROM truth t CROSS JOIN (SELECT unnest([1, 3, 5, 10])::INT AS k) g LEFT JOIN fwd f USING (source1_entity_id, candidate_entity_id)) GROUP BY k""",
    keep=True,
)
def recall_at_k(w) -> DataFrame:
    return measure.recall_at_k(w.forward, w.truth, [1, 3, 5, 10]).select("k", *six("recall"), "pairs")


@query(
    """SELECT country, candidate_entity_id[1:2] AS source, count(*) AS n, round(avg((f.source1_entity_id IS NOT NULL)::INT), 6) AS recall FROM truth t JOIN rec ON entity_id = t.source1_entity_id
LEFT JOIN fwd f USING (source1_entity_id, candidate_entity_id) GROUP BY 1, 2"""
)
def recall_by_group(w) -> DataFrame:
    return measure.recall_by(w.forward.select(*PAIR), w.truth, w.s1).select("country", "source", "n", *six("recall"))


@query("SELECT source1_entity_id, candidate_entity_id FROM truth ANTI JOIN fwd USING (source1_entity_id, candidate_entity_id)")
def missed_pairs(w) -> DataFrame:
    return measure.missed_pairs(w.forward, w.truth)


@query(
    """SELECT round(avg(coalesce((fwd = 1)::INT, 0)), 6) AS recall_forward, round(avg(coalesce((fwd = 1 OR rev_rank <= 3)::INT, 0)), 6) AS recall_reverse, round(avg((c.fwd IS NOT NULL)::INT), 6) AS recall_sibling
FROM truth LEFT JOIN ctx c USING (source1_entity_id, candidate_entity_id)""",
    keep=True,
)
def recall_attribution(w) -> DataFrame:
    df = w.context.withColumn("in_reverse", (F.col("rev_rank") <= SETTINGS.reverse_k).cast("int"))
    return measure.recall_attribution(df, w.truth).select(*six("recall_forward", "recall_reverse", "recall_sibling"))


# Samples.


def _draw(column: str, seed: int = 42) -> str:
    return f"('0x' || md5({column} || '#{seed}')[1:8])::BIGINT"


@query(f"SELECT entity_id FROM rec WHERE src = 'S1' AND {_draw('entity_id')} >= {int(0.18 * sampling.SPAN)}")
def sample_world(w) -> DataFrame:
    return sampling.drop_world(w.s1).select("entity_id")


@query(
    """SELECT entity_id FROM pick UNION ALL SELECT entity_id FROM hit UNION ALL (SELECT entity_id FROM rest WHERE src = 'S2' ORDER BY d, entity_id LIMIT 50) UNION ALL (SELECT entity_id FROM rest WHERE src = 'S3' ORDER BY d, entity_id LIMIT 50)""",
    f"""pick AS (SELECT entity_id FROM rec WHERE src = 'S1' ORDER BY {_draw('entity_id')}, entity_id LIMIT 100), hit AS (SELECT DISTINCT candidate_entity_id AS entity_id FROM truth WHERE source1_entity_id IN (FROM pick)),
rest AS (SELECT entity_id, src, {_draw('entity_id')} AS d FROM rec WHERE src <> 'S1' AND entity_id NOT IN (FROM hit))""",
)
def create_sample(w) -> DataFrame:
    columns = ["entity_id", "business_name", "business_address", "country"]
    return sampling.world_sample(w.s1.select(*columns), w.s23.select(*columns), w.truth, 100, 50).select("entity_id")


@query(f"SELECT entity_id FROM rec WHERE src <> 'S1' AND (entity_id IN (SELECT candidate_entity_id FROM truth) OR {_draw('entity_id')} < {int(0.15 * sampling.SPAN)})")
def sample_with_required(w) -> DataFrame:
    return sampling.with_required(w.s23, w.truth.select("candidate_entity_id"), 0.15).select("entity_id")


@query(f"SELECT source1_entity_id, candidate_entity_id, {_draw('source1_entity_id')} < {int(0.2 * sampling.SPAN)} AS held, ({_draw('source1_entity_id')} % 3)::INT AS fold FROM fwd")
def grouped_split(w) -> DataFrame:
    entity = F.col("source1_entity_id")
    return w.forward.select(*PAIR, sampling.is_validation(entity).alias("held"), sampling.fold(entity).alias("fold"))


# Decisions, on the cosine as a probability.


def _scored(w) -> DataFrame:
    return measure.label_pairs(w.forward.select(*PAIR, F.least(F.lit(1.0), F.col("score")).alias("p")), w.truth)


SHOWN = "SELECT source1_entity_id, candidate_entity_id, p FROM "


@query(SHOWN + oracle.one_to_one("lab"))
def one_to_one(w) -> DataFrame:
    return decide.one_to_one(_scored(w)).select(*PAIR, "p")


@query(SHOWN + threshold_rule("lab", "0.4", "0.5"))
def select_threshold(w) -> DataFrame:
    return decide.select_threshold(_scored(w), 0.4, 0.5).select(*PAIR, "p")


@query(SHOWN + expected_rule("lab", "0.1", "1.2"))
def select_expected(w) -> DataFrame:
    return decide.select_expected(_scored(w), 0.1, 1.2).select(*PAIR, "p")


@query(f05(threshold_rule("lab", "0.4", "0.5")))
def macro_f05(w) -> DataFrame:
    return decide.macro_f05(decide.select_threshold(_scored(w), 0.4, 0.5), w.entities).select(*six("f05"))


def _values(values: list, name: str) -> str:
    return f"(SELECT unnest([{', '.join(map(str, values))}])::DOUBLE AS {name})"


GRID_T = f"(SELECT * FROM {_values(decide.THRESHOLDS, 'threshold')}, {_values(decide.RELATIVE, 'rel')})"
GRID_E = f"(SELECT * FROM {_values(decide.MISSES, 'miss')}, {_values(decide.POWERS, 'power')})"


@query(f05(threshold_rule(f"(SELECT * FROM lab, {GRID_T})", "threshold", "rel", "threshold, rel,"), ("threshold", "rel"), GRID_T), keep=True)
def tune_threshold(w) -> DataFrame:
    return decide.tune_threshold(_scored(w), w.entities).select("threshold", "rel", *six("f05"))


@query(f05(expected_rule(f"(SELECT * FROM lab, {GRID_E})", "miss", "power", "miss, power,"), ("miss", "power"), GRID_E), keep=True)
def tune_expected(w) -> DataFrame:
    return decide.tune_expected(_scored(w), w.entities).select("miss", "power", *six("f05"))


@query("SELECT p AS threshold, (SELECT count(*) FROM lab WHERE label = 1) AS n_positive FROM (SELECT p, row_number() OVER (ORDER BY p) AS r FROM lab WHERE label = 1) WHERE r = floor((1 - 0.9) * (SELECT count(*) FROM lab WHERE label = 1)) + 1", keep=True)
def quantile_threshold(w) -> DataFrame:
    return decide.quantile_threshold(_scored(w), 0.9)


@query(
    """SELECT k.keep, min(c.p) AS threshold, (SELECT count(*) FROM lab WHERE p >= min(c.p)) / (SELECT count(*) FROM ents) AS per_entity
FROM (SELECT unnest([0.8, 0.9, 0.95]) AS keep) k JOIN (SELECT p, row_number() OVER (ORDER BY p) AS r FROM lab WHERE label = 1) c ON c.r = floor((1 - k.keep) * (SELECT count(*) FROM lab WHERE label = 1)) + 1 GROUP BY 1""",
    keep=True,
)
def operating_points(w) -> DataFrame:
    return decide.operating_points(_scored(w), w.entities, (0.8, 0.9, 0.95))


@query(f05("(SELECT * FROM lab WHERE label = 1)"))
def oracle_f05(w) -> DataFrame:
    return decide.oracle_f05(_scored(w), w.entities).select(*six("f05"))


@query(f05("(SELECT * FROM (SELECT * FROM lab QUALIFY p >= 0.4 AND p >= 0.5 * max(p) OVER (PARTITION BY source1_entity_id)) QUALIFY row_number() OVER (PARTITION BY source1_entity_id ORDER BY p DESC, candidate_entity_id) <= 10)"))
def threshold_not_exclusive(w) -> DataFrame:
    return decide.macro_f05(decide.select_threshold(_scored(w), 0.4, 0.5, exclusive=False), w.entities).select(*six("f05"))


@query("SELECT count(*) AS n_pairs, round(avg(label), 6) AS positive_rate FROM lab")
def positive_rate(w) -> DataFrame:
    return _scored(w).agg(F.count(F.lit(1)).alias("n_pairs"), F.round(F.avg("label"), 6).alias("positive_rate"))


@query(
    f"""SELECT c.source1_entity_id, c.candidate_entity_id, p2, p2_rank, p2_max, {six_sql('p2_sum')}, p2_n50, coalesce(p2_second, 0) AS p2_second, round(CASE WHEN p2_max > 0 THEN p2 / p2_max ELSE 0 END, 6) AS p2_rel,
coalesce(sibp_max, 0) AS sibp_max, round(coalesce(sibp_mean, 0), 6) AS sibp_mean, coalesce(sibp_n, 0) AS sibp_n FROM so2 c LEFT JOIN near n ON n.source1_entity_id = c.source1_entity_id AND n.y = c.candidate_entity_id""",
    """so0 AS (SELECT source1_entity_id, candidate_entity_id, least(1.0, score) AS p2 FROM expd), so1 AS (SELECT *, row_number() OVER (PARTITION BY source1_entity_id ORDER BY p2 DESC, candidate_entity_id) AS p2_rank FROM so0),
so2 AS (SELECT *, max(p2) OVER e AS p2_max, sum(p2) OVER e AS p2_sum, sum((p2 >= 0.5)::INT) OVER e AS p2_n50, max(CASE WHEN p2_rank = 2 THEN p2 END) OVER e AS p2_second FROM so1 WINDOW e AS (PARTITION BY source1_entity_id)),
sym AS (SELECT source1_entity_id, anchor AS x, candidate_entity_id AS y FROM edges UNION SELECT source1_entity_id, candidate_entity_id, anchor FROM edges),
near AS (SELECT s.source1_entity_id, s.y, max(p2) AS sibp_max, avg(p2) AS sibp_mean, count(*) AS sibp_n FROM sym s JOIN so0 o ON o.source1_entity_id = s.source1_entity_id AND o.candidate_entity_id = s.x WHERE s.x <> s.y GROUP BY 1, 2)""",
    keep=True,
)
def second_order(w) -> DataFrame:
    df = decide.second_order(w.expanded.select(*PAIR, F.least(F.lit(1.0), F.col("score")).alias("p2")), w.edges)
    return df.select(*PAIR, "p2", "p2_rank", "p2_max", *six("p2_sum"), "p2_n50", "p2_second", *six("p2_rel"), "sibp_max", *six("sibp_mean"), "sibp_n")


# Lists and their rules; the lists of the rules' queries are damaged on purpose.


@query("SELECT entity_id AS source1_entity_id, ids AS candidate_entity_ids FROM lists")
def emit_candidates(w) -> DataFrame:
    return quality.match_lists(w.s1, _scored(w), column="candidate_entity_ids")


@query(
    f"""SELECT r.entity_id AS source1_entity_id, coalesce(l.ids, '') AS matched_entity_ids FROM rec r LEFT JOIN (SELECT source1_entity_id, string_agg(candidate_entity_id, ',' ORDER BY p DESC, candidate_entity_id) AS ids
FROM {threshold_rule('lab', '0.4', '0.5')} GROUP BY 1) l ON l.source1_entity_id = r.entity_id WHERE src = 'S1'"""
)
def emit_matches(w) -> DataFrame:
    return quality.match_lists(w.s1, decide.select_threshold(_scored(w), 0.4, 0.5))


def _lists(w) -> DataFrame:
    return quality.match_lists(w.s1, _scored(w), column="ids").withColumnRenamed("source1_entity_id", "entity_id")


def _damaged(w) -> DataFrame:
    df = _lists(w).join(w.s1.select("entity_id", "doc_id"), "entity_id")
    case = F.col("doc_id") % 11
    ids = F.when(case == 0, F.concat("ids", F.lit(","), "ids")).when(case == 1, F.concat(F.lit("S1-1,"), "ids")).when(case == 2, "X9-1").when(case == 3, "S2-999999999").otherwise(F.col("ids"))
    out = df.where(case != 4).select("entity_id", ids.alias("ids")).unionByName(df.where(case == 5).select("entity_id", "ids"))
    return out.unionByName(w.s1.where(F.col("doc_id") % 11 == 6).select(F.concat(F.lit("S1-x"), F.col("doc_id").cast("string")).alias("entity_id"), F.lit("").alias("ids")))


@query("SELECT entity_id, count(*) AS n FROM bad GROUP BY 1 HAVING count(*) > 1")
def dq_dup_rows(w) -> DataFrame:
    return quality.duplicate_rows(_damaged(w))


@query("SELECT DISTINCT entity_id FROM bad WHERE len(list_distinct(list_filter(string_split(ids, ','), lambda x: x <> ''))) < len(list_filter(string_split(ids, ','), lambda x: x <> ''))")
def dq_dup_ids(w) -> DataFrame:
    return quality.duplicate_ids(_damaged(w))


@query("SELECT entity_id, id FROM badids WHERE starts_with(id, 'S1-')")
def dq_self_match(w) -> DataFrame:
    return quality.self_matches(_damaged(w))


@query("SELECT entity_id, id FROM badids WHERE NOT regexp_matches(id, '^S[123]-')")
def dq_prefix(w) -> DataFrame:
    return quality.bad_prefixes(_damaged(w))


@query("SELECT entity_id, id FROM badids WHERE regexp_matches(id, '^S[23]-') AND id NOT IN (SELECT entity_id FROM rec WHERE src <> 'S1')")
def dq_unknown(w) -> DataFrame:
    return quality.unknown_ids(_damaged(w), w.s23.select("entity_id"))


@query("SELECT entity_id FROM rec WHERE src = 'S1' AND entity_id NOT IN (SELECT entity_id FROM bad)")
def dq_missing(w) -> DataFrame:
    return quality.missing_rows(_damaged(w), w.s1.select("entity_id"))


@query("SELECT DISTINCT entity_id FROM bad WHERE entity_id NOT IN (SELECT entity_id FROM rec)")
def dq_extra(w) -> DataFrame:
    return quality.extra_rows(_damaged(w), w.s1.select("entity_id"))


@query("SELECT DISTINCT entity_id, id FROM badids WHERE (entity_id, id) NOT IN (SELECT (entity_id, unnest(list_filter(string_split(ids, ','), lambda x: x <> ''))) FROM lists)", keep=True)
def dq_not_subset(w) -> DataFrame:
    return quality.not_candidates(_damaged(w), _lists(w))


@query("SELECT count(*) AS n_rows, sum((len(list_filter(string_split(ids, ','), lambda x: x <> '')) = 0)::INT) AS n_empty, sum(len(list_filter(string_split(ids, ','), lambda x: x <> ''))) AS n_ids, max(len(list_filter(string_split(ids, ','), lambda x: x <> ''))) AS most_ids FROM bad")
def dq_statistics(w) -> DataFrame:
    return quality.list_statistics(_damaged(w))


@query("SELECT entity_id, business_name, business_address, country FROM rec WHERE entity_id IN (SELECT candidate_entity_id FROM truth)")
def record_lookup(w) -> DataFrame:
    return R.only(w.records.select("entity_id", "business_name", "business_address", "country"), w.truth.select("candidate_entity_id"))


@query("SELECT entity_id, business_name, business_address, country FROM rec")
def tsv_round_trip(w) -> DataFrame:
    spark = w.records.sparkSession
    path = linkage.shared_folder(spark)
    R.write_tsv(w.records.select("entity_id", "business_name", "business_address", "country"), path)
    return R.read_tsv(spark, path)


# Variants of the bag, by the recall of ten candidates.


#: Options of the bag, and whether half the budget goes to views of names and of addresses.
FIRST, SECOND = {"first": True, "skeleton": ("v1",), "address_skeletons": False}, {"skeleton": ("v1",), "address_skeletons": False}
VARIANTS = {
    "v1": (FIRST, False), "norm v2": (SECOND, False), "norm v2, skel v2": (SECOND | {"skeleton": ("v2",)}, False), "norm v2, skel v1+v2": (SECOND | {"skeleton": ("v1", "v2")}, False),
    "norm v2, concat": (SECOND | {"concat": True}, False), "norm v2, askel": (SECOND | {"address_skeletons": True}, False),
    "v2": ({"skeleton": ("v2",), "concat": True, "address_skeletons": True}, False), "final": ({"skeleton": ("v2",), "address_skeletons": True}, False),
    "v1 + views": (FIRST, True), "norm v2 + views": (SECOND, True),
}
ABLATION_K = 8
_final, _before = oracle.ablation(VARIANTS, SETTINGS.min_idf, ABLATION_K)


@query(_final, _before, keep=True)
def ablation(w) -> DataFrame:
    """Recall of the best eight candidates for each variant, and how many pairs that takes. A job and a row a variant."""
    rows, truth, made = [], linkage.written(w.truth), {}
    for name, (options, views) in VARIANTS.items():
        if (key := repr(options)) not in made:
            made[key] = linkage.written(bag.bags(w.records.select("entity_id", "src", "country", "business_name", "business_address"), **options))
        bags = made[key]
        s1, s23 = bags.where("src = 'S1'"), bags.where("src <> 'S1'")
        if views:
            found = retrieve.multi_view(s1, s23, ABLATION_K, SETTINGS.min_idf, linkage.written)
        else:
            found = retrieve.forward(s1, tuple(map(linkage.written, retrieve.build_index(s23, SETTINGS.min_idf))), ABLATION_K)
        found = linkage.written(found.select(*PAIR))
        rows.append((name, measure.label_pairs(truth, found).agg(F.round(F.avg("label"), 6)).first()[0], found.count()))
    return w.records.sparkSession.createDataFrame(rows, "variant string, recall double, pairs long")


# Learning.


def _learned(name: str):
    def register(make):
        QUERIES[name] = lambda spark, sf_dir: make(linkage.documents(spark, sf_dir, SETTINGS, keep=True))
        return make

    return register


@_learned("stage1_prune")
def stage1_prune(w) -> DataFrame:
    rows = linkage.written(w.labelled)
    scored = model.predict(model.fit(rows, 1, **TREES), rows, "p1").withColumn("p1", F.round("p1", 9))
    return scored.where(F.col("p1") >= model.prune_threshold(scored, SETTINGS.stage1_recall)).select(*PAIR, "p1", "label")


def _full(w) -> DataFrame:
    return linkage.featured(linkage.written(w.labelled), w.prepared)


@_learned("stage2_match")
def stage2_match(w) -> DataFrame:
    full = _full(w)
    return model.predict(model.fit(full, 2, **TREES), full).select(*PAIR, "p", "label")


@_learned("stage3_match")
def stage3_match(w) -> DataFrame:
    third = linkage.written(decide.second_order(linkage.written(model.out_of_fold(_full(w), 2, **TREES)), w.edges))
    return model.predict(model.fit(third, 3, **TREES), third).select(*PAIR, "p", "label")


@_learned("pipeline_e2e")
def pipeline_e2e(w) -> DataFrame:
    matches, _, selection = linkage.link(w.records, w.truth, w.settings)
    return matches.withColumn("rule", F.lit(json.dumps({k: v for k, v in selection.items() if k != "report"}, sort_keys=True)))
