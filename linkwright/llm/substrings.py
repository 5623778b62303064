"""Repeated passages (operator 10): prefix-free parsing in corpus order, sharded.

Every byte is covered by the answer that lies in a string of ``length`` bytes which also starts anywhere else. Texts are
parsed into phrases: a rolling hash of ``TRIGGER`` bytes marks triggers, and a phrase runs from one trigger to the next, so
that equal strings are parsed alike from their first trigger on. A string starting l bytes before its first trigger is the
pair of a phrase's suffix of l bytes and of length - l bytes of the text that the parse goes on with; suffixes of the
dictionary and of the parse together give the corpus order, and a string is repeated if a neighbour in that order shares it.

Only strings with a common first trigger can be equal, so the order is made in shards:

* the key of a trigger is the hash of the bytes that all its strings share, those after the trigger for the short suffixes
  (l < length - ``anchor(length)``), those around it for the long ones; keys that occur once are dropped;
* triggers whose whole context is equal are settled by its hash;
* of the others, a shard sorts the reversed phrase suffixes and the texts after the trigger; in either order the longest
  common prefixes of neighbours say, for each l, which rows have an equal suffix and an equal continuation;
* strings without a trigger lie inside one long phrase and are compared by their own hash.

Beside the exact answer stand ``passages``, what the parse shows by itself at a smaller size: the bytes of strings of
``anchor(length)`` bytes (128 for 400) that start at a trigger and start in another text as well. A passage of n bytes that
two texts share has such a string unless no trigger lies in its first n - 136 bytes, (63/64) ** (n - 136) of the cases: 8 % of
passages of 300 bytes, 2 % of those of 400. Its first and last bytes may lie outside the strings.

Equal texts are one text from the start. Keys shared by a third of all triggers are counted before they are shuffled, and
shards with more than ``HOT`` contexts are settled by counting hashes of their strings instead of sorting.

Defined results: a null text counts as empty; texts of fewer than ``length`` bytes are never touched, equal or not; a text
that occurs more than once (repeated rows and ids included) and is long enough is removed whole, and from ``anchor(length)``
bytes on it is one passage; null ids stay null; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkwright.llm.common import forget, map_text, written

LENGTH, TRIGGER, MODULUS = 400, 8, 64
HOT = 100_000  # contexts that one shard sorts at the most
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
INVERSE = pow(0x9E3779B97F4A7C15, -1, 2**64)
ROW = "key bigint, context bigint, at int, low int, high int"


def anchor(length: int) -> int:
    """Bytes after a trigger that its strings with a short suffix share; a trigger's own bytes and one more at least."""
    return max(TRIGGER + 1, length * 8 // 25)


def mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return x ^ (x >> np.uint64(32))


def rolling(data: bytes) -> np.ndarray:
    """A hash of the TRIGGER bytes at each place (those beyond the end count as zero)."""
    x = np.ndarray((len(data),), "<u8", data + bytes(TRIGGER), strides=(1,)) + MULTIPLIER
    with np.errstate(over="ignore"):
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xD6E8FEB86659FD93)
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xD6E8FEB86659FD93)
    return x


class Text:
    """A text with its triggers, and hashes of its substrings."""

    def __init__(self, data: bytes) -> None:
        self.data, self.n = data, len(data)
        self.m = rolling(data)
        self.triggers = np.flatnonzero(self.m[: max(0, self.n - TRIGGER + 1)] < np.uint64(2**64 // MODULUS))
        # Sums of mixed 8-byte blocks with powers, for each residue of the place modulo 8.
        blocks = -(-self.n // 8) + 1
        self.sums = np.zeros((blocks + 1, 8), np.uint64)
        self.sums[1:].reshape(-1)[: self.n] = self.m
        with np.errstate(over="ignore"):
            self.sums[1:] *= powers_of(int(MULTIPLIER), blocks + 1)[1:, None]
            self.sums = np.cumsum(self.sums, axis=0, dtype=np.uint64).ravel()

    def hashes(self, start: np.ndarray, length: np.ndarray | int) -> np.ndarray:
        """Hashes of substrings within the text; lengths are at least 8."""
        start = np.asarray(start, np.int64)
        length = np.broadcast_to(np.asarray(length, np.int64), start.shape)
        if not len(start):
            return np.zeros(0, np.uint64)
        whole = length // 8 * 8
        with np.errstate(over="ignore"):
            total = self.sums[start + whole] - self.sums[start]
            # Sums start at the block of their first byte; dividing by that power makes them comparable.
            scale = powers_of(INVERSE, int(start.max()) // 8 + 2)
            total *= scale[start // 8 + 1]
            return mix(total ^ mix(self.m[start + length - 8] + length.astype(np.uint64)))  # the last 8 bytes cover the rest


POWERS: dict[int, np.ndarray] = {}


def powers_of(base: int, count: int) -> np.ndarray:
    got = POWERS.get(base)
    if got is None or len(got) < count:
        with np.errstate(over="ignore"):
            got = np.concatenate([np.ones(1, np.uint64), np.multiply.accumulate(np.full(2 * count, base % 2**64, np.uint64))])
        POWERS[base] = got
    return got[:count]


def rows_of(data: bytes, length: int) -> tuple[np.ndarray, ...]:
    """(key, context, at, low, high) of each trigger of a text, and of each string without one (low = -1).

    A row stands for the strings that start l bytes before ``at``, low <= l < high, and fit in the text; with low = -2 for a
    run of ``high`` strings up to ``at`` that the text itself repeats. A row of low = high = 0 stands for no such string: only
    the bytes after its trigger matter.
    """
    n, after = len(data), anchor(length)
    near = length - after  # suffixes from this length on are long
    if n < after:
        return (np.zeros(0, np.uint64), np.zeros(0, np.uint64), *(np.zeros(0, np.int32),) * 3)
    text = Text(data)
    b = text.triggers
    gap = np.diff(b, prepend=-1)
    out = []
    # Short suffixes: the bytes after the trigger are shared.
    ok = n - b >= after
    high = np.minimum(gap, near)
    high[n - b <= length - high] = 0
    out.append((b[ok], np.zeros(ok.sum(), int), high[ok], text.hashes(b[ok], after)))
    # Long suffixes: the bytes around the trigger are shared.
    high = np.minimum(gap, length - TRIGGER + 1)
    ok = (high > near) & (n - b > length - high)
    out.append((b[ok], np.full(ok.sum(), near), high[ok], ~text.hashes(b[ok] - near, near + TRIGGER)))
    at, low, high, key = (np.concatenate(x) for x in zip(*out, strict=True))
    begin, end = at - high + 1, np.minimum(at + length - low, n)
    with np.errstate(over="ignore"):
        context = mix(text.hashes(begin, end - begin) + (high * 1000 + low).astype(np.uint64))
    # Strings without a trigger.
    starts = np.arange(max(0, n - length + 1))
    following = np.append(b, n + length)[np.searchsorted(b, starts)]
    alone = starts[following + TRIGGER > starts + length]
    own, first, which, count = np.unique(mix(text.hashes(alone, length)), return_index=True, return_inverse=True, return_counts=True)
    # A string that the text repeats itself is one row; its places, which are runs, are settled by a row each with a key that
    # the run's first string has, too.
    local = np.flatnonzero(count[which] > 1)
    edge = np.flatnonzero(np.diff(alone[local], prepend=-9, append=n + 9) != 1)
    begin, size = local[edge[:-1]], np.diff(edge)
    run = own[which[begin]]
    return (
        np.concatenate([key, own, run]), np.concatenate([context, own, run]), np.concatenate([at, alone[first], alone[begin] + size - 1]).astype(np.int32),
        np.concatenate([low, np.full(len(own), -1), np.full(len(run), -2)]).astype(np.int32), np.concatenate([high, np.ones(len(own), int), size]).astype(np.int32),
    )


def neighbours(texts: list[bytes], order: list[int]) -> np.ndarray:
    """Common prefix lengths of texts that are neighbours in an order, the first 0."""
    out = np.zeros(len(texts), np.int64)
    width = max(map(len, texts), default=0)
    for begin in range(1, len(order), 4096):
        part = order[begin - 1 : begin + 4096]
        size = np.array([len(texts[i]) for i in part])
        grid = np.frombuffer(b"".join(texts[i].ljust(width, b"\0") for i in part), np.uint8).reshape(len(part), width) if width else np.zeros((len(part), 0), np.uint8)
        differ = grid[1:] != grid[:-1]
        common = np.where(differ.any(1), differ.argmax(1), width) if width else np.zeros(len(part) - 1, int)
        out[begin : begin + 4096] = np.minimum(common, np.minimum(size[1:], size[:-1]))
    return out


def settle(left: list[bytes], right: list[bytes], shard: np.ndarray, low: np.ndarray, high: np.ndarray, length: int) -> list[list[tuple[int, int]]]:
    """Per row the ranges (first, last) of l whose string another row of its shard shares.

    ``left``: the bytes before the trigger, reversed (the phrase suffix that is read backwards); ``right``: those from it on.
    """
    n = len(left)
    place = []
    for texts in (left, right):
        order = sorted(range(n), key=texts.__getitem__)
        place.append((np.array(order), neighbours(texts, order)))
    (by_left, common_left), (by_right, common_right) = place
    have = np.array([len(r) for r in right])
    found: list[list[tuple[int, int]]] = [[] for _ in range(n)]
    _, shard = np.unique(shard, return_inverse=True)
    at_left, at_right = np.empty(n, np.int64), np.empty(n, np.int64)
    for first in range(int(low.min()), int(high.max()), 64):
        hit = np.zeros((n, 64), bool)
        for l in range(first, min(first + 64, int(high.max()))):  # noqa: E741
            rows = np.flatnonzero((low <= l) & (l < high) & (have >= length - l))
            if len(rows) < 2:
                continue
            at_left[by_left] = np.cumsum(common_left < l)
            at_right[by_right] = np.cumsum(common_right < length - l)
            if n < 1_000_000:
                pair = (shard[rows] * (n + 1) + at_left[rows]) * (n + 1) + at_right[rows]
            else:
                pair = np.unique(np.stack([shard[rows], at_left[rows], at_right[rows]]), axis=1, return_inverse=True)[1]
            _, which, count = np.unique(pair, return_inverse=True, return_counts=True)
            hit[rows[count[which] > 1], l - first] = True
        for i in np.flatnonzero(hit.any(1)):
            edge = np.flatnonzero(np.diff(np.concatenate([[0], hit[i].view(np.int8), [0]])))
            for a, z in zip(edge[::2], edge[1::2], strict=True):
                if found[i] and found[i][-1][1] == first + a - 1:
                    found[i][-1] = (found[i][-1][0], int(first + z - 1))
                else:
                    found[i].append((int(first + a), int(first + z - 1)))
    return found


def covered(n: int, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The maximal runs of bytes that the (start, end) spans cover."""
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, min(end, n)))
    return out


def texts_of(docs: DataFrame, id_col: str, text_col: str, whole: bool) -> DataFrame:
    """Per row: doc_id, node (a 64-bit digest of the text), its bytes, and the compressed text if that is asked for."""

    def make():
        squeeze = zstandard.ZstdCompressor(level=3).compress if whole else lambda data: None

        def work(texts):
            out = []
            for text in texts:
                data = (text or "").encode("utf-8", "surrogatepass")
                out.append((int.from_bytes(hashlib.blake2b(data, digest_size=8).digest(), "little", signed=True), len(data), squeeze(data)))
            return out

        return work

    return map_text(docs, make, "node bigint, n_bytes bigint, packed binary", id_col, text_col)


def unpacked(value) -> bytes:
    return zstandard.ZstdDecompressor().decompress(value)


def triggers(nodes: DataFrame, length: int) -> DataFrame:
    """The rows of ``rows_of`` with their node."""

    def run(batches):
        for batch in batches:
            for begin in range(0, batch.num_rows, 256):
                part = batch.slice(begin, 256)
                got = [rows_of(unpacked(v.as_buffer()), length) for v in part.column("packed")]
                sizes = [len(g[0]) for g in got]
                key, context, at, low, high = (np.concatenate(x) for x in zip(*got, strict=True))
                node = np.repeat(part.column("node").to_numpy(), sizes)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(node), pa.array(key.view(np.int64)), pa.array(context.view(np.int64)), pa.array(at), pa.array(low), pa.array(high)],
                    names=["node", "key", "context", "at", "low", "high"],
                )

    return nodes.select("node", "packed").mapInArrow(run, f"node bigint, {ROW}")


def contexts(nodes: DataFrame, open_: DataFrame, length: int) -> DataFrame:
    """The open rows with the bytes before their trigger, reversed, and from it on."""
    asked = open_.groupBy("node").agg(F.collect_list(F.struct("key", "at", "low", "high")).alias("rows"))  # bounded by a text
    both = nodes.select("node", "packed").join(asked, "node")

    def run(batches):
        for batch in batches:
            for begin in range(0, batch.num_rows, 64):
                part, out = batch.slice(begin, 64), []
                for node, value, rows in zip(part.column("node").to_pylist(), part.column("packed"), part.column("rows").to_pylist(), strict=True):
                    data = unpacked(value.as_buffer())
                    for r in rows:
                        b = r["at"]
                        out.append((node, r["key"], b, r["low"], r["high"], data[max(0, b - r["high"] + 1) : b][::-1], data[b : b + length - r["low"]]))
                names = ["node", "key", "at", "low", "high", "left", "right"]
                kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], t) for i, t in enumerate(kinds)], names=names)

    return both.mapInArrow(run, "node bigint, key bigint, at int, low int, high int, left binary, right binary")


def in_order(rows: DataFrame, length: int) -> DataFrame:
    """(node, at, first, last) of the rows whose strings another of their key shares; a key lies in one shard."""
    dealt = rows.repartition(F.col("key")).sortWithinPartitions("key")

    def solve(rows):
        left, right = [r[5] for r in rows], [r[6] for r in rows]
        low, high, key = (np.array([r[i] for r in rows], np.int64) for i in (3, 4, 1))
        found = settle(left, right, key, low, high, length)
        flat = [(r[0], r[2], a, z) for r, spans in zip(rows, found, strict=True) for a, z in spans]
        return pa.RecordBatch.from_arrays([pa.array([f[i] for f in flat], t) for i, t in enumerate((pa.int64(), pa.int32(), pa.int32(), pa.int32()))], names=["node", "at", "first", "last"])

    def run(batches):
        held: list[tuple] = []
        for batch in batches:
            new = list(zip(*(batch.column(i).to_pylist() for i in range(7)), strict=True))
            held += new
            if len(held) > 20_000 and held[0][1] != held[-1][1]:  # whole keys only; the last may go on
                cut = len(held)
                while held[cut - 1][1] == held[-1][1]:
                    cut -= 1
                yield solve(held[:cut])
                held = held[cut:]
        if held:
            yield solve(held)

    return dealt.select("node", "key", "at", "low", "high", "left", "right").mapInArrow(run, "node bigint, at int, first int, last int")


def by_string(rows: DataFrame, length: int) -> DataFrame:
    """The same for keys with very many contexts: every string's hash is counted, with a partial count in each task."""

    def run(batches):
        for batch in batches:
            out = []
            for r in zip(*(batch.column(i).to_pylist() for i in range(7)), strict=True):
                before = r[5][::-1]
                for l in range(r[3], r[4]):  # noqa: E741
                    if l <= len(before) and len(r[6]) >= length - l:
                        string = before[len(before) - l :] + r[6][: length - l]
                        out.append((r[0], r[2], l, int.from_bytes(hashlib.blake2b(string, digest_size=8).digest(), "little", signed=True)))
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], t) for i, t in enumerate((pa.int64(), pa.int32(), pa.int32(), pa.int64()))], names=["node", "at", "first", "string"])

    strings = rows.select("node", "key", "at", "low", "high", "left", "right").mapInArrow(run, "node bigint, at int, first int, string bigint")
    often = strings.groupBy("string").count().where("count > 1").select("string")
    return strings.join(often, "string").select("node", "at", "first", F.col("first").alias("last"))


def repeated(nodes: DataFrame, length: int) -> DataFrame:
    """(node, spans array<struct<at, first, last, shared>>): the strings that start ``first`` to ``last`` bytes before ``at`` are
    repeated; with ``shared``, that many bytes from ``at`` on are in another text, too (first and last are then null)."""
    rows = written(triggers(nodes, length))  # parsing is the dearest step, and two shuffles read it
    often = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), (F.min("node") < F.max("node")).alias("elsewhere")).where("n > 1").select("key", "elsewhere")
    shared = written(rows.join(often, "key"))
    forget(rows)
    none, size = F.lit(None).cast("int"), F.when(F.col("low") == 0, anchor(length)).otherwise(length)
    seen = shared.where("elsewhere AND low IN (0, -1)").select("node", "at", none.alias("first"), none.alias("last"), size.alias("shared"))
    shared = shared.where("high > 0").drop("elsewhere")
    # Equal contexts settle their rows; of each context one row goes on to meet the key's other contexts.
    same = shared.groupBy("key", "context").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("node", "at", "low", "high")).alias("row"))
    same = written(same)
    several = same.groupBy("key").agg(F.count(F.lit(1)).alias("contexts")).where("contexts > 1")
    whole = shared.join(same.where("n > 1").select("key", "context"), ["key", "context"])
    sure = whole.select("node", "at", F.greatest("low", F.lit(0)).alias("first"), F.when(F.col("low") == -1, 0).otherwise(F.col("high") - 1).alias("last"))
    open_ = same.join(several, "key").where("row.low >= 0").select("key", "row.*", "contexts")
    open_ = written(open_)
    hot = open_.where(F.col("contexts") > HOT).limit(1).count() > 0
    found = contexts(nodes, open_, length)
    if hot:
        large = open_.where(F.col("contexts") > HOT).select("key").distinct()
        found = written(found)
        solved = in_order(found.join(large, "key", "left_anti"), length).unionByName(by_string(found.join(large, "key", "left_semi"), length))
    else:
        solved = in_order(found, length)
    spans = sure.unionByName(solved).withColumn("shared", F.lit(None).cast("int")).unionByName(seen)
    return spans.groupBy("node").agg(F.collect_list(F.struct("at", "first", "last", "shared")).alias("spans"))  # bounded by a text


def pairs_of(spans: list[tuple[int, int]]) -> list[dict]:
    return [{"start": a, "end": z} for a, z in spans]


def remove_repeats(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", shown: tuple = ("removed", "passages", "kept")) -> DataFrame:
    """Per row: doc_id, n_bytes, and ``shown``: columns made of removed and passages array<struct<start, end>> (bytes) and kept binary (what stays)."""
    every = texts_of(docs, id_col, text_col, True)
    nodes = written(every.groupBy("node").agg(F.count(F.lit(1)).alias("copies"), F.first("packed").alias("packed"), F.first("n_bytes").alias("n_bytes")))
    least = anchor(length)
    spans = repeated(nodes.where(F.col("n_bytes") >= least), length)
    both = nodes.join(spans, "node", "left")
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches):
        for batch in batches:
            for begin in range(0, batch.num_rows, 64):
                part = batch.slice(begin, 64)
                removed, passages, kept = [], [], []
                for copies, value, found in zip(part.column("copies").to_pylist(), part.column("packed"), part.column("spans").to_pylist(), strict=True):
                    data = unpacked(value.as_buffer())
                    n, found = len(data), found or []
                    whole = [(0, n)] if copies > 1 else []
                    strings = [s for s in found if not s["shared"]]
                    fitting = [(s["at"] - s["last"], s["at"] - first + length) for s in strings if (first := max(s["first"], s["at"] + length - n)) <= s["last"]]
                    elsewhere = [(s["at"], s["at"] + s["shared"]) for s in found if s["shared"]]
                    own = whole if whole and n >= length else covered(n, fitting)
                    removed.append(pairs_of(own))
                    passages.append(pairs_of(whole if whole and n >= least else covered(n, elsewhere)))
                    edges = [0, *(x for span in own for x in span), n]
                    kept.append(b"".join(data[a:z] for a, z in zip(edges[::2], edges[1::2], strict=True)))
                columns = [part.column("node"), part.column("n_bytes"), pa.array(removed, kind), pa.array(passages, kind), pa.array(kept, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["node", "n_bytes", "removed", "passages", "kept"])

    spans_type = "array<struct<start:bigint,end:bigint>>"
    texts = both.select("node", "n_bytes", "copies", "packed", "spans").mapInArrow(run, f"node bigint, n_bytes bigint, removed {spans_type}, passages {spans_type}, kept binary")
    return texts_of(docs, id_col, text_col, False).select("doc_id", "node").join(texts.select("node", "n_bytes", *shown), "node").drop("node")


def digest(docs: DataFrame) -> DataFrame:
    """What the query op10 returns; n_passages and n_passage_bytes count passages that stand in another text as well."""
    size = lambda spans: F.aggregate(spans, F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    line = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"))), ",")
    shown = (
        size("removed").alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"), line("removed").alias("removed"),
        F.size("passages").cast("long").alias("n_passages"), size("passages").alias("n_passage_bytes"),
    )
    return remove_repeats(docs, shown=shown)
