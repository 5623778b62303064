"""Approximate nearest neighbours (operator 9): hierarchical navigable small-world graphs, one per shard.

Equal vectors are one node, which keeps the ids that can be among the nearest. Nodes are dealt by hash to shards of about
``shard`` nodes, 4,096 for small tables and a 64th of the nodes, but not above 65,536, for large ones; each shard builds its
graph and stores it as flat arrays (vectors, levels, neighbour lists of fixed width). A set of queries is searched in every shard, in blocks, and the shards' results are merged; distances are then
Euclidean ones in double precision on the original vectors. Every valid row is indexed.

Defined results: vectors that are null, empty, zero, or hold null or non-finite components, and rows with a null id, take
no part; a query meets candidates of its own dimension only; rows with equal id and vector count once, and rows that share
a query's id are never its results; ties go to the smaller id; with fewer candidates than asked for all are returned; an
empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

from heapq import heappop, heappush, heapreplace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkwright.llm.common import written

LINKS, EF_BUILD, EF_SEARCH, SHARD, QUERY_BLOCK = 12, 64, 96, 4096, 2048
MOST_NODES, SHARD_BYTES = 65_536, 256_000_000  # of a shard


class Graph:
    """A navigable small-world graph over the rows of a matrix; ``links[level]`` holds neighbours, -1 where there is none."""

    def __init__(self, vectors: np.ndarray, links: list[np.ndarray], entry: int, width: int = LINKS) -> None:
        self.x, self.links, self.entry, self.width = vectors, links, entry, width
        self.norm = np.einsum("ij,ij->i", vectors, vectors)

    @classmethod
    def build(cls, vectors: np.ndarray, width: int = LINKS, ef: int = EF_BUILD, seed: int = 5) -> Graph:
        n = len(vectors)
        level = np.minimum((-np.log(np.random.default_rng(seed).random(n)) / np.log(width)).astype(int), 12)
        order = np.argsort(-level, kind="stable")  # from the top down, so that every level is entered from above
        graph = cls(vectors, [np.full((n, width * (2 if k == 0 else 1)), -1, np.int32) for k in range(int(level.max()) + 1)], int(order[0]), width)
        filled = [np.zeros(n, np.int64) for _ in graph.links]
        for i in map(int, order[1:]):
            at, top = graph.entry, len(graph.links) - 1
            for k in range(top, int(level[i]), -1):
                at = graph.nearest(k, vectors[i], at, 1)[0][1]
            for k in range(min(top, int(level[i])), -1, -1):
                found = graph.nearest(k, vectors[i], at, ef)
                at = found[0][1]
                chosen = graph.spread([j for _, j in found], i, width)
                graph.links[k][i, : len(chosen)] = chosen
                filled[k][i] = len(chosen)
                for j in chosen:
                    graph.connect(k, j, i, filled[k])
        return graph

    def connect(self, k: int, j: int, i: int, filled: np.ndarray) -> None:
        """Adds i to j's neighbours; a full list keeps those that spread best."""
        row = self.links[k][j]
        if filled[j] < len(row):
            row[filled[j]] = i
            filled[j] += 1
            return
        near = np.append(row, i)
        gap = self.norm[near] - 2 * (self.x[near] @ self.x[j])
        keep = self.spread(near[np.argsort(gap, kind="stable")].tolist(), j, len(row))
        row[:] = -1
        row[: len(keep)] = keep
        filled[j] = len(keep)

    def spread(self, near: list[int], i: int, most: int) -> list[int]:
        """Of candidates by rising distance from i: first those closer to i than to one that was chosen, then others."""
        x = self.x[near]
        own = self.norm[near] - 2 * (x @ self.x[i]) + self.norm[i]
        between = self.norm[near][:, None] - 2 * (x @ x.T) + self.norm[near][None]
        chosen, closest = [], np.full(len(near), np.inf)
        for a in range(len(near)):
            if own[a] < closest[a]:
                chosen.append(a)
                if len(chosen) == most:
                    break
                np.minimum(closest, between[a], out=closest)
        if len(chosen) < most:
            taken = set(chosen)
            chosen += [a for a in range(len(near)) if a not in taken][: most - len(chosen)]
        return [near[a] for a in chosen]

    def nearest(self, k: int, q: np.ndarray, start: int, ef: int) -> list[tuple[float, int]]:
        """(squared distance less the query's norm, row) of about the ef nearest on a level, nearest first."""
        links, seen = self.links[k], bytearray(len(self.x))
        d = float(self.norm[start] - 2 * (self.x[start] @ q))
        seen[start] = 1
        open_, best = [(d, start)], [(-d, start)]
        while open_:
            d, i = heappop(open_)
            if len(best) >= ef and d > -best[0][0]:
                break
            new = [j for j in links[i].tolist() if j >= 0 and not seen[j]]
            if not new:
                continue
            for j in new:
                seen[j] = 1
            for d, j in zip((self.norm[new] - 2 * (self.x[new] @ q)).tolist(), new, strict=True):
                if len(best) < ef:
                    heappush(best, (-d, j))
                    heappush(open_, (d, j))
                elif d < -best[0][0]:
                    heapreplace(best, (-d, j))
                    heappush(open_, (d, j))
        return sorted((-d, j) for d, j in best)

    def search(self, q: np.ndarray, ef: int) -> list[int]:
        at = self.entry
        for k in range(len(self.links) - 1, 0, -1):
            at = self.nearest(k, q, at, 1)[0][1]
        return [j for _, j in self.nearest(0, q, at, ef)]


def usable(vector: Column) -> Column:
    ok = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vector.isNotNull() & (F.size(vector) > 0) & F.coalesce(ok, F.lit(False)) & F.exists(vector, lambda x: x != 0)


def nodes_of(rows: DataFrame, keep: int) -> DataFrame:
    """Per distinct vector: vector, dimension and the ``keep`` smallest of its ids, sorted.

    A vector that a third of the rows share is cut to ``keep`` ids in 64 parts before these meet.
    """
    part = F.pmod(F.xxhash64("id"), F.lit(64))
    for keys in (["vector", part], ["vector"]):
        rows = rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy("id"))).where(F.col("_n") <= keep).drop("_n")
    return rows.groupBy("vector").agg(F.array_sort(F.collect_list("id")).alias("ids")).withColumn("size", F.size("vector"))


def parts_for(groups: int) -> int:
    """Partitions over which so many equal groups are dealt by hash: mostly one of them in each."""
    return min(4 * groups, 20_000)


def shard_size(nodes: int, dimension: int) -> int:
    """Nodes of a shard: more for larger tables, as every query is searched in every shard, up to what a worker holds."""
    return max(1, min(max(SHARD, nodes // 64), MOST_NODES, SHARD_BYTES // (8 * max(1, dimension))))


def index(rows: DataFrame, shard: int | None = None, width: int = LINKS, ef: int = EF_BUILD, keep: int = 11) -> DataFrame:
    """A row per shard: dimension, ids of each node, and the graph's flat arrays. ``rows``: id, vector, all usable, distinct."""
    nodes = written(nodes_of(rows, keep))
    count, dimension = nodes.agg(F.count(F.lit(1)), F.max("size")).first()
    shards = max(1, -(-count // (shard or shard_size(count, dimension or 1))))

    def build(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("ids", key=lambda s: s.map(lambda x: x[0]), kind="stable")
        x = np.stack(frame["vector"].to_numpy()).astype(np.float64)
        graph = Graph.build(x, width, ef)
        ids = frame["ids"].tolist()
        return pd.DataFrame(
            {
                "shard": [int(frame["shard"].iloc[0])], "size": [x.shape[1]], "nodes": [len(x)], "vectors": [x.tobytes()], "entry": [graph.entry], "links": [[a.tobytes() for a in graph.links]],
                "ids": [np.concatenate(ids).astype(np.int64).tobytes()], "ends": [np.cumsum([len(i) for i in ids]).astype(np.int64).tobytes()],
            }
        )

    dealt = nodes.withColumn("shard", F.pmod(F.xxhash64("vector"), F.lit(shards)).cast("int")).repartition(parts_for(shards), "size", "shard")
    return dealt.groupBy("size", "shard").applyInPandas(build, "shard int, size int, nodes long, vectors binary, entry long, links array<binary>, ids binary, ends binary")


def search(graphs: DataFrame, queries: DataFrame, k: int = 10, ef: int = EF_SEARCH, width: int = LINKS, block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, vec_id, score) of each query's k nearest in each shard. ``queries``: id, vector, all usable.

    A graph and a block of queries meet by dimension, shard and block, so that there are as many tasks as shards times blocks.
    """
    n, shards = max(1, -(-queries.count() // block)), (graphs.agg(F.max("shard")).first()[0] or 0) + 1
    number = lambda of: F.explode(F.sequence(F.lit(0), F.lit(of - 1)))
    blocks = queries.withColumn("size", F.size("vector")).withColumn("block", F.pmod(F.xxhash64("id"), F.lit(n)).cast("int"))
    blocks = blocks.groupBy("size", "block").agg(F.collect_list("id").alias("query"), F.collect_list("vector").alias("asked"))  # of bounded size
    keys = ["size", "shard", "block"]
    dealt = lambda rows: rows.repartition(parts_for(shards * n), *keys)
    pairs = dealt(graphs.withColumn("block", number(n))).join(dealt(blocks.withColumn("shard", number(shards))), keys)

    def run(frames):
        for frame in frames:
            for row in frame.itertuples(index=False):
                x = np.frombuffer(row.vectors, np.float64).reshape(row.nodes, row.size)
                links = [np.frombuffer(b, np.int32).reshape(row.nodes, -1) for b in row.links]
                graph = Graph(x, links, row.entry, width)
                ids, ends = np.frombuffer(row.ids, np.int64), np.frombuffer(row.ends, np.int64)
                found = []
                for query, asked in zip(row.query, row.asked, strict=True):
                    q = np.asarray(asked, np.float64)
                    near = graph.search(q, ef)[: k + 1]
                    score = np.sqrt(((x[near] - q) ** 2).sum(1))
                    own = sorted((s, int(i)) for s, j in zip(score.tolist(), near, strict=True) for i in ids[ends[j - 1] if j else 0 : ends[j]] if i != query)
                    found += [(query, i, s) for s, i in own[:k]]
                yield pd.DataFrame(found, columns=["query_id", "vec_id", "score"])

    return pairs.mapInPandas(run, "query_id bigint, vec_id bigint, score double")


def nearest(rows: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", shard: int | None = None) -> DataFrame:
    """Per query row its k nearest: query_id, rank, vec_id, score. ``is_query`` is a predicate on the column ``id``."""
    vector = F.col(vector_col).cast("array<double>")
    own = rows.select(F.col(id_col).cast("bigint").alias("id"), vector.alias("vector")).where(F.col("id").isNotNull() & usable(F.col("vector"))).distinct()
    graphs = written(index(own, shard, keep=k + 1))
    asked = own.where(is_query)
    found = search(graphs, asked, k)
    # An id with several vectors is several queries of one id: its nearest over all of them, each candidate once.
    found = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def digest(rows: DataFrame) -> DataFrame:
    """What the query op9 returns: queries are the rows whose id is divisible by 100."""
    return nearest(rows, F.col("id") % 100 == 0)
