"""Bags of prefixed features of a record's name and address."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkwright.functions import text as T


def _tag(prefix: str, values: Column) -> Column:
    return F.transform(values, lambda x: F.concat(F.lit(prefix), x))


def _longer(values: Column, least: int) -> Column:
    return F.filter(values, lambda x: F.length(x) >= least)


#: Versions of skeletons: their prefix, and whether they are the first generation's.
SKELETONS = {"v1": ("k1_", True), "v2": ("k_", False)}


def name_features(df: DataFrame, name: str = "business_name", concat: bool = False, first: bool = False, skeleton: tuple[str, ...] = ("v2",)) -> tuple[DataFrame, Column]:
    """Tokens n_, skeletons k_ and bigrams b_ (and run-together c_ forms, if asked for) of a name."""
    df = df.withColumn("_n", T.without(T.tokens(F.col(name), first), T.NAME_STOP))
    n = F.col("_n")
    pairs = F.when(F.size(n) >= 2, F.transform(F.sequence(F.lit(1), F.size(n) - 1), lambda i: F.concat(F.lit("b_"), F.get(n, i - 1), F.lit("_"), F.get(n, i)))).otherwise(F.array().cast("array<string>"))
    parts = [_tag("n_", _longer(n, 2)), *(_tag(prefix, _longer(T.skeletons(n, old), 3)) for prefix, old in map(SKELETONS.get, skeleton)), pairs]
    if concat:
        whole = lambda k: F.when(F.size(n) >= k, F.array(F.concat(F.lit("c_"), F.array_join(F.slice(n, 1, k), "")))).otherwise(F.array().cast("array<string>"))
        parts += [_tag("c_", _longer(n, 8)), whole(2), whole(3)]
    return df, F.concat(*parts)


def address_features(df: DataFrame, address: str = "business_address", skeletons: bool = True, first: bool = False) -> tuple[DataFrame, Column]:
    """Numbers d_, number and next word dw_, words a_ and their skeletons ak_ of an address.

    The first generation keeps zeros and number words.
    """
    own = T.tokens(F.col(address), first)
    df = df.withColumn("_a", T.mapped(own if first else T.mapped(own, T.NUMBER_WORDS), T.ADDRESS))
    a, plain = F.col("_a"), (lambda t: t) if first else T.no_zeros
    df = df.withColumn("_w", F.filter(a, lambda t: ~T.is_number(t) & (F.length(t) >= 3)))
    follow = F.transform(a, lambda t, i: F.when(T.is_number(t) & ~T.is_number(F.get(a, i + 1)), F.concat(F.lit("dw_"), plain(t), F.lit("_"), F.get(a, i + 1))))
    parts = [F.transform(F.filter(a, T.is_number), lambda t: F.concat(F.lit("d_"), plain(t))), F.filter(follow, lambda x: x.isNotNull()), _tag("a_", F.col("_w"))]
    if skeletons:
        parts.append(_tag("ak_", _longer(T.skeletons(F.col("_w")), 3)))
    return df, F.concat(*parts)


def bags(records: DataFrame, concat: bool = False, address_skeletons: bool = True, first: bool = False, skeleton: tuple[str, ...] = ("v2",)) -> DataFrame:
    """``records`` with ``bag``, the distinct features of each. ``first``: of the first generation's tokens."""
    columns = records.columns
    df, name = name_features(records, "business_name", concat, first, skeleton)
    df, address = address_features(df, "business_address", address_skeletons, first)
    return df.withColumn("bag", F.array_distinct(F.concat(name, address))).select(*columns, "bag")


def features(records: DataFrame, **options) -> DataFrame:
    """Long form: entity_id, country, feature."""
    return bags(records, **options).select("entity_id", "country", F.explode("bag").alias("feature"))


def first_generation_keys(records: DataFrame) -> DataFrame:
    """entity_id and the five composite keys of the first generation as rows (key_no, key); null keys are left out."""
    clean = lambda c: T.expand_abbreviations(T.clean_text(F.col(c)))
    df = records.select("entity_id", clean("business_name").alias("n"), clean("business_address").alias("a"))
    word = lambda c, i: F.when(F.col(c) != "", F.element_at(F.split(c, " "), i))
    prefix = lambda c: F.substring(c, 1, 4)
    pairs = [(prefix("n"), word("a", 1)), (word("n", 1), word("a", -1)), (prefix("n"), prefix("a")), (word("n", -1), word("a", 1)), (word("n", 1), word("a", 1))]
    keys = F.array(*[F.struct(F.lit(i + 1).alias("key_no"), F.concat(x, F.lit("_"), y).alias("key")) for i, (x, y) in enumerate(pairs)])
    return df.select("entity_id", F.explode(keys).alias("k")).select("entity_id", "k.*").where("key IS NOT NULL")


def first_generation_pairs(left: DataFrame, right: DataFrame) -> DataFrame:
    """Distinct pairs of records that share a key, by one join over all five."""
    a = first_generation_keys(left).select(F.col("entity_id").alias("source1_entity_id"), "key_no", "key")
    b = first_generation_keys(right).select(F.col("entity_id").alias("candidate_entity_id"), "key_no", "key")
    return a.join(b, ["key_no", "key"]).select("source1_entity_id", "candidate_entity_id").distinct()
