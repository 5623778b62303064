"""Near duplicates among texts (operator 8): MinHash with banding, signature verification and connected components.

A text's set holds its distinct shingles of ``words`` words (A-Z in lower case, split at ASCII white space); two texts are
linked if the Jaccard similarity of their sets is at least ``threshold``. Texts with equal sets are one node from the start.
Nodes get the minima of ``bands * rows + extra`` universal hash functions; those that agree on all rows of a band share a
bucket, so a pair at the threshold of 0.8 shares none with a probability of 2e-7. The signature, a byte of each minimum,
estimates the similarity. Within a bucket no pairs are listed:

1. every member is compared with the bucket's smallest node, first by signature, then on the full sets;
2. components of these links are taken; a bucket whose members lie in one component is done;
3. in the other buckets the members outside the largest component are compared with all of another component, in blocks of
   bounded size and by signature; each member's likeliest partners are compared on the full sets, and their links join
   components;
4. what is still apart is compared on the full sets with every partner that may reach the threshold, block by block, where
   the texts of those that have such partners are brought; only links leave a block.

Every pair that shares a bucket is so either compared or known to be connected, at no cap on a bucket's size.

Defined results: a null, empty or blank text has an empty set and is linked with nothing, as are rows with a null id (their
component is null); rows with one id are one node; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkwright.llm.common import map_text, scratch, written
from linkwright.llm.components import components

BANDS, ROWS, EXTRA, SEED = 40, 5, 400, 11
WORDS, THRESHOLD = 5, 0.8
DEVIATIONS = 5  # of a signature's estimate, by which a pair may lie below the threshold and is still compared on the full sets
BLOCK = 1024  # members of a bucket on a side of a comparison
LIKELIEST = 2  # partners a member and block in step 3
CACHE = 150_000


class Words(dict):
    """64-bit hashes of words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def shingles(text: str | None, words: int, known: dict) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a text's shingles."""
    own = (text or "").encode("utf-8", "surrogatepass").lower().split()
    h = np.fromiter(map(known.__getitem__, own), np.uint64, len(own))
    n = max(1, len(h) - words + 1) if len(h) else 0
    out = np.full(n, len(h) if len(h) < words else words, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(min(words, len(h))):
            out = (out ^ (out >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) + h[i : i + n]
        out ^= out >> np.uint64(32)
        out *= np.uint64(0xD6E8FEB86659FD93)
        out ^= out >> np.uint64(32)
    return np.unique(out)


def hash_functions(count: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return rng.integers(0, 2**31, count, dtype=np.uint32) * np.uint32(2) + np.uint32(1), rng.integers(0, 2**32, count, dtype=np.uint32)


def minima(own: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The minimum of (a * x + b) mod 2**32 over x, the upper half of a shingle's hash, for each function."""
    x = (own >> np.uint64(32)).astype(np.uint32)
    least = np.full(len(a), np.iinfo(np.uint32).max, np.uint32)
    with np.errstate(over="ignore"):
        for at in range(0, len(x), 128):
            h = np.multiply.outer(a, x[at : at + 128])
            h += b[:, None]
            np.minimum(least, h.min(1), out=least)
    return least


def signed(docs: DataFrame, words: int, bands: int, rows: int, extra: int, seed: int, id_col: str, text_col: str) -> DataFrame:
    """Per row: doc_id, n_shingles, set_id (a digest of the set), keys (a bucket for each band), signature (a byte a function)."""

    def make():
        known, (a, b) = Words(), hash_functions(bands * rows + extra, seed)
        band = np.arange(bands, dtype=np.uint64)

        def work(texts):
            out = []
            for text in texts:
                own = shingles(text, words, known)
                digest = hashlib.blake2b(own.tobytes(), digest_size=16).digest()
                if not len(own):
                    out.append((0, digest, [], b""))
                    continue
                least = minima(own, a, b)
                with np.errstate(over="ignore"):
                    key = (band + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
                    for r in range(rows):
                        key = (key ^ (key >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + least[r : bands * rows : rows]
                out.append((len(own), digest, key.view(np.int64), (least >> np.uint32(8) & np.uint32(255)).astype(np.uint8).tobytes()))
            return out

        return work

    return map_text(docs, make, "n_shingles bigint, set_id binary, keys array<bigint>, signature binary", id_col, text_col)


def alike(pairs: DataFrame, nodes: DataFrame, least: float) -> DataFrame:
    """The pairs (x, y) whose signatures agree in a share of at least ``least``."""
    side = lambda c: nodes.select(F.col("node").alias(c), F.col("signature").alias(f"s{c}"))
    both = pairs.join(side("x"), "x").join(side("y"), "y").select("x", "y", "sx", "sy")
    schema = pairs.select("x", "y").schema

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                one, two = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for c in ("sx", "sy"))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["x", "y"]).filter(pa.array((one == two).mean(1) >= least))

    return both.mapInArrow(run, schema)


def confirmed(pairs: DataFrame, docs: DataFrame, words: int, threshold: float, id_col: str, text_col: str) -> DataFrame:
    """The pairs whose full sets reach the threshold. Only texts of the pairs are moved."""
    pairs = written(pairs)
    ids = written(pairs.select(F.col("x").alias("id")).unionByName(pairs.select(F.col("y").alias("id"))).distinct())
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).join(ids, "id", "left_semi")
    texts = written(texts.dropDuplicates(["id", "text"]))
    side = lambda c: texts.select(F.col("id").alias(c), F.col("text").alias(f"t{c}"))
    both = pairs.join(side("x"), "x").join(side("y"), "y").select("x", "y", "tx", "ty")
    schema = pairs.select("x", "y").schema
    share = round(threshold * 100)

    def run(batches):
        known, last, last_set = Words(), None, None
        for batch in batches:
            keep = []
            for tx, ty in zip(batch.column("tx"), batch.column("ty"), strict=True):
                one, two = shingles(tx.as_py(), words, known), ty.as_py()
                if two != last:
                    last, last_set = two, shingles(two, words, known)
                small, large = sorted((len(one), len(last_set)))
                common = len(np.intersect1d(one, last_set, assume_unique=True)) if 100 * small >= share * large else 0
                keep.append(bool(common) and 100 * common >= share * (small + large - common))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["x", "y"]).filter(pa.array(keep, pa.bool_()))

    return written(both.mapInArrow(run, schema).distinct())


def open_buckets(buckets: DataFrame, labels: DataFrame) -> DataFrame:
    """key, node, component of the members of buckets with several components, and the component that most of them have."""
    one = buckets.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    share = one.groupBy("key", "component").agg(F.count(F.lit(1)).alias("n"))
    main = share.groupBy("key").agg(F.max(F.struct("n", "component")).alias("top"), F.sum("n").alias("all"), F.count(F.lit(1)).alias("parts")).where("parts > 1")
    main = main.select("key", F.col("top.component").alias("main"), F.ceil((F.col("all") - F.col("top.n")) / BLOCK).alias("rows"), F.ceil(F.col("all") / BLOCK).alias("columns"))
    return one.join(main, "key")


def tiles_of(members: DataFrame, nodes: DataFrame) -> DataFrame:
    """Blocks of open buckets: those outside the main component (``outer``) against all, at most BLOCK or so on a side."""
    salt = lambda n: F.pmod(F.xxhash64("node"), F.col(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    left = members.where("component <> main").select("key", "node", "component", salt("rows").alias("row"), every("columns").alias("column"), F.lit(True).alias("outer"))
    right = members.select("key", "node", "component", every("rows").alias("row"), salt("columns").alias("column"), F.lit(False).alias("outer"))
    return left.unionByName(right).join(nodes.select("node", "signature", "keys"), "node").select("key", "row", "column", "node", "component", "outer", "signature", "keys")


def partners(rows: pa.Table, least: float, likeliest: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Of whole blocks, which stand one after the other: rows of pairs in different components whose signatures agree enough.

    ``likeliest``: how many partners a member has in a block; without it all, and a pair in the first band that it shares only.
    """
    size = rows.num_rows
    sign = np.frombuffer(b"".join(rows["signature"].to_pylist()), np.uint8).reshape(size, -1)
    keys = rows["keys"].combine_chunks().flatten().to_numpy().reshape(size, -1)
    node, part, outer = (rows[c].to_numpy() for c in ("node", "component", "outer"))
    place = [rows[c].to_numpy() for c in ("key", "row", "column")]
    edges = np.flatnonzero(np.concatenate([[True], np.any([p[1:] != p[:-1] for p in place], axis=0), [True]]))
    one, two = [], []
    for begin, end in zip(edges[:-1], edges[1:], strict=True):
        own = outer[begin:end]
        inner = np.flatnonzero(~own) + begin
        for i in np.flatnonzero(own) + begin:
            near = inner[part[inner] != part[i]]
            agree = (sign[near] == sign[i]).mean(1)
            near, agree = near[agree >= least], agree[agree >= least]
            if likeliest:
                near = near[np.lexsort((node[near], -agree))[:likeliest]]
            elif len(near):
                near = near[keys[i, (keys[near] == keys[i]).argmax(1)] == place[0][i]]
            if len(near):
                one.append(np.full(len(near), i))
                two.append(near)
    return (np.concatenate(one), np.concatenate(two)) if one else (np.zeros(0, int), np.zeros(0, int))


def by_block(tiles: DataFrame, work, schema) -> DataFrame:
    """``work`` (a table of whole blocks to a record batch) over all blocks, which are dealt and sorted, not collected."""

    def run(batches):
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([batch])
            rows = rows if held is None else pa.concat_tables([held, rows])
            place = [rows[c].to_numpy() for c in ("key", "row", "column")]
            changes = np.flatnonzero(np.any([p[1:] != p[:-1] for p in place], axis=0)) + 1
            cut = int(changes[-1]) if len(changes) else 0  # the last block may go on
            if cut:
                yield from work(rows.slice(0, cut)).to_batches()
            held = rows.slice(cut)
        if held is not None:
            yield from work(held).to_batches()

    return tiles.repartition("key", "row", "column").sortWithinPartitions("key", "row", "column").mapInArrow(run, schema)


def pair_table(rows: pa.Table, one: np.ndarray, two: np.ndarray) -> pa.Table:
    a, b = rows["node"].take(pa.array(one)), rows["node"].take(pa.array(two))
    swap = pc.less(a, b)
    return pa.table({"x": pc.if_else(swap, b, a), "y": pc.if_else(swap, a, b)})


def across(members: DataFrame, nodes: DataFrame, least: float, likeliest: int) -> DataFrame:
    """Likely pairs (x, y) of nodes that share an open bucket and lie in different components."""
    schema = nodes.select(F.col("node").alias("x"), F.col("node").alias("y")).schema
    return by_block(tiles_of(members, nodes), lambda rows: pair_table(rows, *partners(rows, least, likeliest)), schema).distinct()


def rest(members: DataFrame, nodes: DataFrame, docs: DataFrame, least: float, words: int, threshold: float, id_col: str, text_col: str) -> DataFrame:
    """Every link between different components of open buckets. Texts go to the blocks where they have a partner at all."""
    tiles = tiles_of(members, nodes)

    def involved(rows: pa.Table) -> pa.Table:
        return rows.take(pa.array(np.unique(np.concatenate(partners(rows, least, None)))))

    some = written(by_block(tiles, involved, tiles.schema))
    ids = written(some.select(F.col("node").alias("id")).distinct())
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).join(ids, "id", "left_semi").dropDuplicates(["id", "text"])
    share = round(threshold * 100)

    def settle(rows: pa.Table) -> pa.Table:
        one, two = partners(rows, least, None)
        known, sets, keep = Words(), {}, np.zeros(len(one), bool)
        for n, pair in enumerate(zip(one.tolist(), two.tolist(), strict=True)):
            for i in pair:
                if i not in sets:
                    sets[i] = shingles(rows["text"][i].as_py(), words, known)
            a, b = (sets[i] for i in pair)
            small, large = sorted((len(a), len(b)))
            common = len(np.intersect1d(a, b, assume_unique=True)) if 100 * small >= share * large else 0
            keep[n] = bool(common) and 100 * common >= share * (small + large - common)
        return pair_table(rows, one[keep], two[keep])

    schema = nodes.select(F.col("node").alias("x"), F.col("node").alias("y")).schema
    return written(by_block(some.join(texts, F.col("node") == F.col("id")).drop("id"), settle, schema).distinct())


def merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``labels`` (node, component; a component's smallest node has none) after more links, which are taken between components."""
    end = lambda c: labels.select(F.col("node").alias(c), F.col("component").alias(f"c{c}"))
    joined = links.join(end("x"), "x", "left").join(end("y"), "y", "left").select(F.coalesce("cx", "x").alias("a"), F.coalesce("cy", "y").alias("b"))
    outer = components(joined, "a", "b")
    moved = labels.join(outer.select(F.col("node").alias("component"), F.col("component").alias("to")), "component", "left")
    return written(moved.select("node", F.coalesce("to", "component").alias("component")).unionByName(outer.select("node", "component")))


def judged(docs: DataFrame, words: int = WORDS, threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS, extra: int = EXTRA, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """What ``near_duplicates`` returns, and set_id."""
    every = written(signed(docs, words, bands, rows, extra, seed, id_col, text_col))
    usable = every.where("n_shingles > 0 AND doc_id IS NOT NULL")
    nodes = written(usable.groupBy("set_id").agg(F.min("doc_id").alias("node"), F.first("keys").alias("keys"), F.first("signature").alias("signature")))
    placed = nodes.select("node", F.explode("keys").alias("key"))
    shared = placed.groupBy("key").agg(F.min("node").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    buckets = written(placed.join(shared, "key"))
    estimate = threshold - DEVIATIONS * (threshold * (1 - threshold) / (bands * rows + extra)) ** 0.5
    stars = buckets.where("node <> first").select(F.col("node").alias("x"), F.col("first").alias("y")).distinct()
    links = confirmed(alike(stars, nodes, estimate), docs, words, threshold, id_col, text_col)
    labels = components(links, "x", "y")
    members = written(open_buckets(buckets.select("key", "node"), labels))
    for step in (3, 4):
        if step == 3:
            more = confirmed(across(members, nodes, estimate, LIKELIEST), docs, words, threshold, id_col, text_col)
        else:
            more = rest(members, nodes, docs, estimate, words, threshold, id_col, text_col)
        if not more.isEmpty():
            labels = merged(labels, more)
        if step == 3:  # a bucket that is done stays done
            members = written(open_buckets(members.select("key", "node"), labels))
    final = nodes.select("set_id", "node").join(labels, "node", "left").select("set_id", F.coalesce("component", "node").alias("component_id"))
    out = every.select("doc_id", "n_shingles", "set_id").join(final, "set_id", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", "set_id", component.alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id (the smallest id reachable over links), kept (whether that is its own)."""
    return judged(docs, **options).drop("set_id")


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with one document of each group: that with the smallest id. Of rows with equal id and text one stays.

    An id goes as a whole unless its rows differ in ``kept``; then its texts, mostly none, are told apart by their sets.
    """
    id_col, text_col = options.get("id_col", "doc_id"), options.get("text_col", "text")
    with scratch(docs.sparkSession) as made:  # signatures, buckets and links are of no use any more
        own = written(judged(docs, **options).where("doc_id IS NOT NULL").select(F.col("doc_id").alias(id_col), "set_id", "kept"))
        made.pop()
    verdict = written(own.groupBy(id_col).agg(F.max("kept").alias("some"), F.min("kept").alias("all")).where("NOT all"))
    torn = verdict.where("some").select(id_col)
    stay = docs.join(verdict.select(id_col), id_col, "left_anti").select(*docs.columns)
    if not torn.isEmpty():
        doubtful = docs.join(torn, id_col, "left_semi").select(*docs.columns)
        key = F.sha2(F.coalesce(F.col(text_col).cast("string"), F.lit("")), 256)
        named = signed(doubtful.select(key.alias("_key"), text_col), options.get("words", WORDS), 1, 1, 0, options.get("seed", SEED), "_key", text_col)
        sets = written(named.select(F.col("doc_id").alias("_key"), "set_id").distinct())
        good = own.where("kept").join(torn, id_col, "left_semi").select(id_col, "set_id").distinct()
        stay = stay.unionByName(doubtful.withColumn("_key", key).join(sets, "_key").join(good, [id_col, "set_id"], "left_semi").select(*docs.columns))
    again = written(docs.where(F.col(id_col).isNotNull()).groupBy(id_col).count().where("count > 1").select(id_col))  # mostly none
    return stay.join(again, id_col, "left_anti").select(*docs.columns).unionByName(stay.join(again, id_col, "left_semi").select(*docs.columns).dropDuplicates([id_col, text_col]))


def digest(docs: DataFrame) -> DataFrame:
    """What the query op8 returns: shingles of two words, a similarity of 0.8."""
    return near_duplicates(docs, words=2, threshold=0.8)
