"""Prepared records and the string, set, number and IDF features of pairs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkwright.functions import text as T
from linkwright.operators.similarity import jaccard, kernels

# The features' names in the models' order, the cap of a difference and what counts as near.
STRING = [
    "name_ratio", "name_tset", "name_tsort", "name_partial", "name_jw", "core_ratio", "core_tset", "core_partial", "core_concat_ratio", "skel_ratio", "skel_tset", "core_jacc",
    "name_len_a", "name_len_b", "addr_ratio", "addr_tset", "addr_partial", "addr_jacc", "num_jacc", "num_shared", "num_conflict", "num_a", "num_b", "max_shared_num_len",
    "postcode_match", "postcode_conflict", "addr_empty_b", "addr_empty_a", "name_nonascii_b", "is_s3", "name_w_jacc", "name_w_cov_a", "name_w_cov_b", "name_w_miss_a",
    "name_w_miss_b", "addr_w_jacc", "addr_w_cov_a", "addr_w_cov_b", "addr_w_miss_a", "addr_w_miss_b", "num1_eq", "num1_diff", "num1_prefix", "num_near_miss", "num_min_diff",
    "acro_ab", "acro_ba", "name_extra_a", "name_extra_b",
]
MOST_DIFFERENCE, NEAR = 1_000_000, 20


def prepare(records: DataFrame) -> DataFrame:
    """entity_id, country and the normal forms that pair features need."""
    df = records.withColumn("nt", T.tokens(F.col("business_name"))).withColumn("at", T.mapped(T.tokens(F.col("business_address")), T.ADDRESS_PAIR))
    df = df.withColumn("core", T.without(F.col("nt"), T.LEGAL))
    # Romanised records say themselves what their names were.
    nonascii = F.col("name_nonascii") if "name_nonascii" in df.columns else F.coalesce(F.col("business_name").rlike(r"[^\x00-\x7F]"), F.lit(False))
    return df.select(
        "entity_id", "country", F.array_join("nt", " ").alias("name"), F.array_join("core", " ").alias("core_name"), F.array_join(T.skeletons(F.col("core")), " ").alias("skel"),
        F.array_join("core", "").alias("concat"), F.array_join("at", " ").alias("addr"), F.array_distinct(F.transform(F.filter("at", T.is_number), T.no_zeros)).alias("nums"),
        F.array_distinct("core").alias("core_set"), F.array_distinct("at").alias("addr_set"), nonascii.alias("nonascii"),
        (F.coalesce("business_address", F.lit("")) == "").alias("addr_empty"), T.number_sequence(F.col("at")).alias("seq"), T.initials(F.col("core")).alias("initials"), "nt", "at",
    )


def token_weights(prepared: DataFrame, idf: DataFrame) -> DataFrame:
    """``prepared`` with name_w and addr_w: the IDF of each token's feature, 0 where the index has none."""
    names = F.transform(F.filter("nt", lambda t: ~t.isin(T.NAME_STOP) & (F.length(t) >= 2)), lambda t: F.struct(F.lit("name").alias("side"), t.alias("token"), F.concat(F.lit("n_"), t).alias("feature")))
    canon = T.mapped(T.mapped(F.col("at"), T.NUMBER_WORDS), T.ADDRESS)
    of = lambda t: F.when(T.is_number(t), F.concat(F.lit("d_"), T.no_zeros(t))).when(F.length(t) >= 3, F.concat(F.lit("a_"), t))
    parts = F.transform(F.filter(F.transform(canon, of), lambda f: f.isNotNull()), lambda f: F.struct(F.lit("addr").alias("side"), f.alias("token"), f.alias("feature")))
    long = prepared.select("entity_id", "country", F.explode(F.array_distinct(F.concat(names, parts))).alias("t")).select("entity_id", "country", "t.*")
    long = long.join(idf, ["country", "feature"], "left").withColumn("w", F.coalesce("idf", F.lit(0.0)))
    entry = lambda side: F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("side") == side, F.struct("token", "w")))))
    maps = long.groupBy("entity_id").agg(entry("name").alias("name_w"), entry("addr").alias("addr_w"))
    none = F.create_map().cast("map<string,double>")
    return prepared.join(maps, "entity_id", "left").withColumns({"name_w": F.coalesce("name_w", none), "addr_w": F.coalesce("addr_w", none)})


#: What others of a prepared record say already, so that it is made of them after the joins and no pair carries it to its place.
DERIVED = {"concat": lambda r: F.replace(r["core_name"], F.lit(" "), F.lit("")), "core_set": lambda r: F.array_distinct(T.words(r["core_name"])), "addr_set": lambda r: F.array_distinct(T.words(r["addr"]))}


def sides(pairs: DataFrame, prepared: DataFrame) -> DataFrame:
    """``pairs`` with both records as structs a and b, without their tokens."""
    carried = F.struct(*[c for c in prepared.columns if c not in ("country", "nt", "at", *DERIVED)])
    a = prepared.select(F.col("entity_id").alias("source1_entity_id"), carried.alias("a"))
    b = prepared.select(F.col("entity_id").alias("candidate_entity_id"), carried.alias("b"))
    again = [c for c in DERIVED if c in prepared.columns]
    whole = lambda r: reduce(lambda x, c: x.withField(c, DERIVED[c](r)), again, r)
    return pairs.join(a, "source1_entity_id").join(b, "candidate_entity_id").withColumns({"a": whole(F.col("a")), "b": whole(F.col("b"))})


def number(c: Column) -> Column:
    return c.cast("double")


def set_features(a: Column, b: Column) -> dict[str, Column]:
    shared, conflict = F.array_intersect(a["nums"], b["nums"]), (F.size(a["nums"]) > 0) & (F.size(b["nums"]) > 0) & ~F.arrays_overlap(a["nums"], b["nums"])
    code = lambda x: F.filter(x["nums"], lambda n: F.length(n).between(5, 6))
    acronym = lambda x, y: (x["initials"] != "") & (F.array_contains(y["core_set"], x["initials"]) | (y["concat"] == x["initials"]))
    return {
        "core_jacc": jaccard(a["core_set"], b["core_set"]), "name_len_a": number(F.size(a["core_set"])), "name_len_b": number(F.size(b["core_set"])), "addr_jacc": jaccard(a["addr_set"], b["addr_set"]),
        "num_jacc": jaccard(a["nums"], b["nums"]), "num_shared": number(F.size(shared)), "num_conflict": number(conflict), "num_a": number(F.size(a["nums"])), "num_b": number(F.size(b["nums"])),
        "max_shared_num_len": number(F.coalesce(F.array_max(F.transform(shared, F.length)), F.lit(0))), "postcode_match": number(F.arrays_overlap(code(a), code(b))),
        "postcode_conflict": number((F.size(code(a)) > 0) & (F.size(code(b)) > 0) & ~F.arrays_overlap(code(a), code(b))), "addr_empty_b": number(b["addr_empty"]), "addr_empty_a": number(a["addr_empty"]),
        "name_nonascii_b": number(b["nonascii"]), "is_s3": number(b["entity_id"].startswith("S3-")), "acro_ab": number(acronym(a, b)), "acro_ba": number(acronym(b, a)),
        "name_extra_a": number(F.size(F.array_except(a["core_set"], b["core_set"]))), "name_extra_b": number(F.size(F.array_except(b["core_set"], a["core_set"]))),
    }


def number_features(a: Column, b: Column) -> dict[str, Column]:
    la, lb = a["seq"], b["seq"]
    some = (F.size(la) > 0) & (F.size(lb) > 0)
    first_a, first_b = F.get(la, F.lit(0)), F.get(lb, F.lit(0))
    text_a, text_b = first_a.cast("string"), first_b.cast("string")
    gaps = F.transform(F.filter(la, lambda x: ~F.array_contains(lb, x)), lambda x: F.array_min(F.transform(lb, lambda y: F.abs(x - y))))
    prefix = (first_a != first_b) & (text_a.startswith(text_b) | text_b.startswith(text_a))
    when = lambda c, other: F.when(some, number(c)).otherwise(other)
    return {
        "num1_eq": when(first_a == first_b, -1.0), "num1_diff": when(F.least(F.abs(first_a - first_b), F.lit(MOST_DIFFERENCE)), -1.0), "num1_prefix": when(prefix, 0.0),
        "num_near_miss": when(F.size(F.filter(gaps, lambda g: (g > 0) & (g <= NEAR))), 0.0), "num_min_diff": when(F.when(F.size(gaps) > 0, F.least(F.array_min(gaps), F.lit(MOST_DIFFERENCE))).otherwise(-1), -1.0),
    }


def weight_features(a: Column, b: Column, side: str) -> dict[str, Column]:
    """Overlap weighted by IDF; what is shared has the weights of a."""
    wa, wb = a[f"{side}_w"], b[f"{side}_w"]
    total = lambda m: F.aggregate(F.map_values(m), F.lit(0.0), lambda s, w: s + w)
    missing = lambda m, other: F.map_filter(m, lambda k, _: ~F.map_contains_key(other, k))
    common = total(F.map_filter(wa, lambda k, _: F.map_contains_key(wb, k)))
    share = lambda d: F.when(d > 0, common / d).otherwise(0.0)
    heaviest = lambda m: F.coalesce(F.array_max(F.map_values(m)), F.lit(0.0))
    names = [f"{side}_w_{x}" for x in ("jacc", "cov_a", "cov_b", "miss_a", "miss_b")]
    return dict(zip(names, (share(total(wa) + total(wb) - common), share(total(wa)), share(total(wb)), heaviest(missing(wa, wb)), heaviest(missing(wb, wa))), strict=True))


def string_features(a: Column, b: Column) -> tuple[dict[str, Column], dict[str, str]]:
    """The struct columns of the kernels, and where in them each feature lies."""
    structs = {
        "_name": kernels(a["name"], b["name"], "ratio", "tset", "tsort", "partial", "jw"), "_core": kernels(a["core_name"], b["core_name"], "ratio", "tset", "partial"),
        "_concat": kernels(a["concat"], b["concat"], "ratio"), "_skel": kernels(a["skel"], b["skel"], "ratio", "tset"), "_addr": kernels(a["addr"], b["addr"], "ratio", "tset", "partial"),
    }
    places = {f"name_{x}": f"_name.{x}" for x in ("ratio", "tset", "tsort", "partial", "jw")} | {f"{p}_{x}": f"_{p}.{x}" for p, xs in (("core", ("ratio", "tset", "partial")), ("skel", ("ratio", "tset")), ("addr", ("ratio", "tset", "partial"))) for x in xs}
    return structs, places | {"core_concat_ratio": "_concat.ratio"}


def pair_features(pairs: DataFrame, prepared: DataFrame) -> DataFrame:
    """``pairs`` with the 49 features of STRING; ``prepared`` has token weights. Filter pairs before: kernels are the slow part."""
    columns = pairs.columns
    df, a, b = sides(pairs, prepared), F.col("a"), F.col("b")
    structs, places = string_features(a, b)
    plain = set_features(a, b) | number_features(a, b) | weight_features(a, b, "name") | weight_features(a, b, "addr")
    df = df.withColumns(structs)
    made = plain | {n: F.col(p) for n, p in places.items()}
    return df.select(*columns, *[made[n].alias(n) for n in STRING])
