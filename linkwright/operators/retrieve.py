"""Feature index and top-K retrieval by cosine of IDF-weighted bags, within a country.

Features that are too frequent are pruned by ``min_idf``. The pairs that share one of the others still grow with the square of
the records, so they are never rows of a table: a block of queries meets a shard of the index in one task, which adds up the
posting lists of one query after another and hands on the best of each. What is shuffled is records, not pairs.
Scores are rounded to nine places before they are ranked, so that ranks don't depend on the order of summation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

REVERSE_K = 3
#: ln 1000: suits indexes of millions of records; small ones need a lower one.
MIN_IDF = 6.907755278982137
#: A country's queries come in blocks of so many, in larger ones rather than in more than CELLS cells of block and shard; both
#: bound how often the index is copied. MOST is the most of a block; a shard has so many postings. These bound what a task holds.
BLOCK, CELLS, MOST, SHARD = 32_000, 32, 256_000, 3_000_000


def document_counts(bags: DataFrame) -> DataFrame:
    return bags.groupBy("country").agg(F.count(F.lit(1)).alias("n"))


def document_frequency(bags: DataFrame) -> DataFrame:
    """country, feature, df."""
    return bags.select("country", F.explode("bag").alias("feature")).groupBy("country", "feature").agg(F.count(F.lit(1)).alias("df"))


def inverse_frequency(bags: DataFrame, min_idf: float = MIN_IDF) -> DataFrame:
    """country, feature, idf = ln(n / (1 + df)) of features that reach ``min_idf``."""
    counts = F.broadcast(document_counts(bags))  # a row a country
    return document_frequency(bags).join(counts, "country").select("country", "feature", F.log(F.col("n") / (1 + F.col("df"))).alias("idf")).where(F.col("idf") >= min_idf)


def weighted(bags: DataFrame, idf: DataFrame) -> DataFrame:
    """entity_id, country, feature, w: weights by an index's IDF at unit length; features outside it weigh nothing."""
    long = bags.select("entity_id", "country", F.explode("bag").alias("feature")).join(idf, ["country", "feature"])
    norm = F.sqrt(F.sum(F.col("idf") * F.col("idf")).over(Window.partitionBy("entity_id")))
    return long.withColumn("w", F.col("idf") / norm).select("entity_id", "country", "feature", "w")


def build_index(bags: DataFrame, min_idf: float = MIN_IDF) -> tuple[DataFrame, DataFrame]:
    """(postings, idf). Both may be written partitioned by country and read again."""
    idf = inverse_frequency(bags, min_idf)
    return weighted(bags, idf), idf


def save_index(postings: DataFrame, idf: DataFrame, path: str) -> None:
    postings.repartition("country", "feature").write.mode("overwrite").partitionBy("country").parquet(f"{path}/postings")
    idf.write.mode("overwrite").partitionBy("country").parquet(f"{path}/idf")


def load_index(spark, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/idf")


def _listed(rows: DataFrame, name: str) -> DataFrame:
    """country, ``name``, features and weights: a row an entity, from the long form."""
    lists = rows.groupBy("country", F.col("entity_id").alias(name)).agg(F.sort_array(F.collect_list(F.struct("feature", "w"))).alias("_f"))
    return lists.select("country", name, F.col("_f.feature").alias("features"), F.col("_f.w").alias("weights"))


def _cells(queries: DataFrame, postings: DataFrame) -> DataFrame:
    """country, blocks, shards: how often the queries and the index of each country are divided."""
    n = queries.groupBy("country").agg(F.count(F.lit(1)).alias("n")).join(postings.groupBy("country").agg(F.count(F.lit(1)).alias("m")), "country")
    parts = lambda c, size: F.ceil(F.col(c) / size)
    blocks = F.greatest(F.least(parts("n", BLOCK), F.ceil(F.lit(CELLS) / parts("m", SHARD))), parts("n", MOST))
    return n.select("country", blocks.alias("blocks"), parts("m", SHARD).alias("shards"))


def _best_of_cell(k: int):
    """The function of (queries, candidates), both Arrow tables as ``_listed`` makes them, to each query's k best candidates."""

    def best(queries, candidates):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        def lists(t):
            names, weights = (pa.concat_arrays(t.column(c).chunks) for c in ("features", "weights"))
            return pc.list_value_length(names).to_numpy(zero_copy_only=False), names.flatten(), weights.flatten().to_numpy()

        kind = lambda x: pa.array(x, pa.float64())
        if not queries.num_rows or not candidates.num_rows:
            return pa.table({"query": pa.array([], pa.string()), "candidate": pa.array([], pa.string()), "score": kind([])})
        # Candidates get numbers in the order of their ids, so that ties go to the smaller number.
        candidates = candidates.take(pc.sort_indices(candidates.column("candidate")))
        sizes, names, weights = lists(candidates)
        coded = names.dictionary_encode()
        code, own = coded.indices.to_numpy(), np.repeat(np.arange(len(sizes)), sizes)
        order = np.lexsort((own, code))
        code, own, weights = code[order], own[order], weights[order]
        first = np.flatnonzero(np.r_[True, (code[1:] != code[:-1]) | (own[1:] != own[:-1])])
        code, own, weights = code[first], own[first], np.add.reduceat(weights, first)
        begins = np.searchsorted(code, np.arange(len(coded.dictionary) + 1)).tolist()

        sizes, names, asked = lists(queries)
        codes = pc.index_in(names, value_set=coded.dictionary).fill_null(-1).to_numpy()
        ends, start, total = np.cumsum(sizes).tolist(), 0, np.zeros(candidates.num_rows)
        known: dict = {}
        none = np.zeros(0, np.int64), np.zeros(0)
        found = []
        for end in ends:
            has = codes[start:end] >= 0
            mine, by = codes[start:end][has], asked[start:end][has]
            start = end
            same = (mine.tobytes(), by.tobytes())
            if same not in known:
                met = []
                for c, w in zip(mine.tolist(), by.tolist(), strict=True):
                    at = own[begins[c] : begins[c + 1]]
                    total[at] += w * weights[begins[c] : begins[c + 1]]
                    met.append(at)
                known[same] = none
                if met:
                    at = np.concatenate(met)
                    score = total[at]
                    total[at] = 0
                    # A candidate is met once a feature at most, so k candidates at least are among the k * features best.
                    few = k * len(met)
                    if len(at) > few:
                        near = score >= np.partition(score, len(at) - few)[len(at) - few] - 1e-8
                        at, score = at[near], score[near]
                    at, once = np.unique(at, return_index=True)
                    score = score[once]
                    best_first = np.lexsort((at, -np.round(score, 9)))[:k]
                    known[same] = at[best_first], score[best_first]
            found.append(known[same])
        whose = np.repeat(np.arange(len(found)), [len(at) for at, _ in found])
        taken = lambda t, c, i: pc.take(pa.concat_arrays(t.column(c).chunks), pa.array(i))
        return pa.table({"query": taken(queries, "query", whose), "candidate": taken(candidates, "candidate", np.concatenate([at for at, _ in found])), "score": kind(np.concatenate([s for _, s in found]))})

    return best


def best_scores(queries: DataFrame, postings: DataFrame, idf: DataFrame, k: int) -> DataFrame:
    """query, candidate, score: each query's k best of each shard of the index, among all that share a feature with it."""
    cells = F.broadcast(_cells(queries, postings))  # a row a country
    dealt = lambda c, n: F.pmod(F.xxhash64(c), F.col(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(n) - 1))
    q = _listed(weighted(queries, idf), "query").join(cells, "country").select("*", dealt("query", "blocks").alias("block"), every("shards").alias("shard"))
    c = _listed(postings, "candidate").join(cells, "country").select("*", dealt("candidate", "shards").alias("shard"), every("blocks").alias("block"))
    by = ["country", "block", "shard"]
    side = lambda df, name: df.select(*[F.col(x).alias(x) for x in (*by, name, "features", "weights")]).groupBy(*by)  # noqa: E731  # both may come of one table
    met = side(q, "query").cogroup(side(c, "candidate")).applyInArrow(_best_of_cell(k), "query string, candidate string, score double")
    return met.withColumn("score", F.round("score", 9)).where("score > 0")


def top_k(scores: DataFrame, k: int) -> DataFrame:
    """query, candidate, score, rank of each query's k best; ties go to the smaller candidate id."""
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "candidate"))
    return scores.withColumn("rank", rank).where(F.col("rank") <= k)


def retrieve(queries: DataFrame, postings: DataFrame, idf: DataFrame, k: int) -> DataFrame:
    return top_k(best_scores(queries, postings, idf, k), k)


def forward(s1: DataFrame, s23_index: tuple, k: int = 50) -> DataFrame:
    """source1_entity_id, candidate_entity_id, score, rank."""
    return retrieve(s1, *s23_index, k).withColumnsRenamed({"query": "source1_entity_id", "candidate": "candidate_entity_id"})


def reverse(s23: DataFrame, s1_index: tuple, r: int = REVERSE_K) -> DataFrame:
    """b, s1, rscore, rrank: the best first-source records of each other record."""
    return retrieve(s23, *s1_index, r).withColumnsRenamed({"query": "b", "candidate": "s1", "score": "rscore", "rank": "rrank"})


def reverse_summary(rev: DataFrame) -> DataFrame:
    """b, rev_best, rev_second (0 where there is none)."""
    place = lambda n: F.coalesce(F.max(F.when(F.col("rrank") == n, F.col("rscore"))), F.lit(0.0))
    return rev.groupBy("b").agg(place(1).alias("rev_best"), place(2).alias("rev_second"))


def relative_cut(pairs: DataFrame, share: float) -> DataFrame:
    """Pairs that score at least a share of their query's best."""
    return pairs.withColumn("_best", F.max("score").over(Window.partitionBy("source1_entity_id"))).where(F.col("score") >= share * F.col("_best")).drop("_best")


def view(bags: DataFrame, prefixes: tuple[str, ...]) -> DataFrame:
    """Bags with only the features of some prefixes."""
    keep = lambda x: F.substring_index(x, "_", 1).isin(*prefixes)
    return bags.withColumn("bag", F.filter("bag", keep))


NAME_VIEW, ADDRESS_VIEW = ("n", "k", "k1", "b", "c"), ("d", "dw", "a", "ak")


def multi_view(s1: DataFrame, s23: DataFrame, k: int, min_idf: float = MIN_IDF, keep=lambda df: df) -> DataFrame:
    """Distinct pairs from half the budget on whole bags and a quarter each on names and on addresses.

    ``keep`` gets each index and each view's pairs; where it writes them, no more than one view's retrieval runs at a time.
    """
    out = None
    for share, prefixes in ((2, NAME_VIEW + ADDRESS_VIEW), (4, NAME_VIEW), (4, ADDRESS_VIEW)):
        index = tuple(map(keep, build_index(view(s23, prefixes), min_idf)))
        got = keep(forward(view(s1, prefixes), index, k // share).select("source1_entity_id", "candidate_entity_id"))
        out = got if out is None else out.unionByName(got)
    return out.distinct()
