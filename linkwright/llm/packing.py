"""Best-fit packing of documents into token sequences (operator 4): a linear grouping scheme.

Texts are tokenised and cut into pieces of at most ``CAPACITY`` tokens. What follows needs only how many pieces have each
length, a table of at most CAPACITY rows, so the driver makes a plan whose size does not depend on the corpus:

* large lengths are sorted, dealt into groups of equal cardinality and rounded up to the largest of their group;
* for these few sizes the configurations of a sequence are optimised (the linear program of the cutting-stock problem, by
  column generation) and rounded down to whole numbers;
* actual lengths are put in the place of rounded ones, which leaves gaps of many sizes;
* what is left, and then the small lengths, goes in falling order to the tightest gap that holds it.

The plan says which ranks of each length go to which sequences and offsets; pieces are ranked within their length and look
their place up.

Documents that have places in an order (``order_col``, whole numbers from 0, as the mix gives them) are packed by windows of
consecutive places, each with a plan of its own, and pieces of a length are ranked by place. Sequences are numbered by window,
so whoever reads them by number meets the documents in the order, up to a window; within one, lengths are spread evenly. There
are at most ``WINDOWS`` windows, of ``WINDOW`` places at least, so that plans stay bounded and windows fill their sequences.

Defined results: a null text counts as empty; an empty text is its end token alone; an empty table gives an empty table;
repeated rows and ids are packed as pieces of their own (equal ones are interchangeable); null ids stay null; other columns
are not read. Whole texts are tokenised; special tokens' strings in a text are ordinary text.
"""

from __future__ import annotations

import re
import sys
import unicodedata
import zlib
from array import array
from math import ceil, gcd

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkwright.llm.common import map_text, once, ranked, written

CAPACITY, END = 2048, 0
#: Shares of the capacity from which on a length is large, each with a number of groups. All are tried, and the plan with
#: the fewest sequences stays: a low share suits a corpus with many short documents, a high one leaves more to best fit.
SCHEMES = ((1 / 8, 24), (1 / 3, 24), (0.48, 24))
WINDOW, WINDOWS, PARTS = 8192, 64, 16  # places of a window, windows, and ranges of places of a window that are ranked apart
CACHE = 300_000  # words whose ids a task keeps
NOT_LATIN = re.compile("[^\x00-ɏ]")  # texts with such characters go to the tokenizer as they are


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@once
def words_pattern() -> re.Pattern:
    """The byte-level tokenizer's own splitting of a text into words, for characters below U+0250."""
    kind = lambda k: "".join(re.escape(c) for c in map(chr, range(0x250)) if unicodedata.category(c)[0] == k)
    letter, number, space = kind("L"), kind("N"), "\\t-\\r \x85\xa0"
    return re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{letter}]+| ?[{number}]+| ?[^{space}{letter}{number}]+|[{space}]+(?![^{space}])|[{space}]+")


def packed(ids: list[int]) -> bytes:
    out = array("I", ids)
    if sys.byteorder == "big":
        out.byteswap()
    return out.tobytes()


def byte_letters() -> dict[int, str]:
    """The letters that a byte-level vocabulary writes bytes with: printable ones as they are, others from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


def token_maker(path: str):
    """A function from texts to the bytes of their ids (unsigned, little-endian, 32 bits), each with the end token.

    A byte-level tokenizer splits a text into words before all else, so a word goes through its model once and is known
    from then on; texts that its splitting isn't written down for here, and other tokenizers, take the whole way.
    """
    from tokenizers import Tokenizer, pre_tokenizers

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    step, end = tokenizer.pre_tokenizer, packed([END])
    by_word = isinstance(step, pre_tokenizers.ByteLevel) and step.use_regex and not step.add_prefix_space and tokenizer.normalizer is None
    known: dict[str, bytes] = {}
    split, letters, model = words_pattern().findall, byte_letters(), tokenizer.model

    def whole(text: str) -> bytes:
        return packed(tokenizer.encode(text, add_special_tokens=False).ids)

    def ids_of(texts: list[str | None]) -> list[bytes]:
        texts = [x or "" for x in texts]
        words = [split(t) if by_word and not NOT_LATIN.search(t) else None for t in texts]
        if len(known) > CACHE:
            known.clear()
        for w in set().union(*filter(None, words)) - known.keys():
            known[w] = packed([x.id for x in model.tokenize(w.encode("utf-8", "surrogatepass").decode("latin-1").translate(letters))])
        return [(whole(t) if w is None else b"".join(map(known.__getitem__, w))) + end for t, w in zip(texts, words, strict=True)]

    return ids_of


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of n tokens; only the first may be shorter than the capacity."""
    first = n % capacity or capacity
    return [(0, first)] + [(s, capacity) for s in range(first, n, capacity)]


def pieces_of(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str | None = None, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, and if asked for ids, compressed (``unpacked`` reads them)."""
    path = tokenizer or default_tokenizer()

    def make():
        ids_of, squeeze = token_maker(path), zstandard.ZstdCompressor(level=1).compress

        def work(texts):
            out = []
            for data in ids_of(texts):
                own = []
                for start, length in cut(len(data) // 4, capacity):
                    part = data[4 * start : 4 * (start + length)]
                    own.append({"start": start, "length": length, "ids_crc32": zlib.crc32(part)} | ({"ids": squeeze(part)} if with_ids else {}))
                out.append((own,))
            return out

        return work

    inner = "start:bigint,length:bigint,ids_crc32:bigint" + ",ids:binary" * with_ids
    got = map_text(docs, make, f"pieces array<struct<{inner}>>", id_col, text_col)
    return got.select("doc_id", F.posexplode("pieces").alias("piece", "p")).select("doc_id", "piece", "p.*")


def unpacked(ids: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(ids), "<u4").astype(np.int32)


def configurations(sizes: list[int], demand: list[int], capacity: int) -> list[tuple[np.ndarray, int]]:
    """Configurations and how often each is used, from the linear program rounded down; together within the demand."""
    k = len(sizes)
    size, need = np.array(sizes), np.array(demand, float)
    basis = np.diag(capacity // size).astype(float)
    inverse = np.diag(1 / np.diag(basis))
    amount = inverse @ need
    for _ in range(40 * k):
        price = inverse.sum(0)
        column, value = best_configuration(size, price, capacity)
        if value <= 1 + 1e-7:
            break
        change = inverse @ column
        if not (change > 1e-9).any():
            break
        ratio = np.where(change > 1e-9, amount / np.maximum(change, 1e-9), np.inf)
        out = int(ratio.argmin())
        amount = amount - ratio[out] * change
        amount[out] = ratio[out]
        basis[:, out] = column
        pivot = inverse[out] / change[out]
        inverse = inverse - np.outer(change, pivot)
        inverse[out] = pivot
    whole = np.floor(amount + 1e-6).astype(int)
    return [(basis[:, i].astype(int), int(whole[i])) for i in range(k) if whole[i] > 0]


def best_configuration(size: np.ndarray, price: np.ndarray, capacity: int) -> tuple[np.ndarray, float]:
    """The most valuable multiset of sizes within the capacity (an unbounded knapsack)."""
    order = np.argsort(size)
    sizes, prices = size[order], np.maximum(price[order], 0)
    best, pick = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    fits = np.searchsorted(sizes, np.arange(capacity + 1), side="right")
    for c in range(int(sizes[0]), capacity + 1):
        n = fits[c]
        gain = best[c - sizes[:n]] + prices[:n]
        i = int(gain.argmax())
        if gain[i] > best[c - 1] + 1e-12:
            best[c], pick[c] = gain[i], i
        else:
            best[c] = best[c - 1]
    column, c = np.zeros(len(size)), capacity
    while c > 0:
        if pick[c] < 0:
            c -= 1
        else:
            column[order[pick[c]]] += 1
            c -= int(sizes[pick[c]])
    return column, float(best[capacity])


def plan(counts: dict[int, int], groups: int, large: int, capacity: int = CAPACITY) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Entries (length, low, wide, sequence, offset) and the number of sequences.

    Rank r of a length lies in the entry with the largest low <= r, in sequence + (r - low) % wide, at
    offset + (r - low) // wide * length.
    """
    left, used, entries, sequences = dict(counts), dict.fromkeys(counts, 0), [], 0
    gaps: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]
    mask = 0

    def put(length: int, n: int, wide: int, sequence: int, offset: int) -> None:
        entries.append((length, used[length], wide, sequence, offset))
        used[length] += n
        left[length] -= n

    def open_gap(sequence: int, n: int, gap: int) -> None:
        nonlocal mask
        if n and gap:
            gaps[gap].append((sequence, n))
            mask |= 1 << gap

    big = sorted((x for x in counts if large <= x < capacity), reverse=True)
    total = sum(counts[x] for x in big)
    if total:
        # Groups of equal cardinality; a length that fills several makes one, so that sizes differ.
        each, runs, filled = ceil(total / groups), [[]], 0
        for x in big:
            if filled >= each:
                runs.append([])
                filled = 0
            runs[-1].append(x)
            filled += counts[x]
        sizes, demand = [r[0] for r in runs], [sum(counts[x] for x in r) for r in runs]
        for column, times in configurations(sizes, demand, capacity):
            segments = [(sequences, times, 0)]  # sequence, how many, tokens so far
            sequences += times
            for g in range(len(sizes)):
                for _ in range(column[g]):
                    split, queue = [], [x for x in runs[g] if left[x]]
                    for first, n, so_far in segments:
                        while n:
                            x = queue[0]
                            take = min(n, left[x])
                            put(x, take, take, first, so_far)
                            split.append((first, take, so_far + x))
                            first, n = first + take, n - take
                            if not left[x]:
                                queue.pop(0)
                    segments = split
            for first, n, so_far in segments:
                open_gap(first, n, capacity - so_far)
    for x in sorted(counts, reverse=True):
        while left[x]:
            fitting = mask >> x << x
            if fitting:
                gap = (fitting & -fitting).bit_length() - 1
                first, n = gaps[gap].pop()
                if not gaps[gap]:
                    mask ^= 1 << gap
            else:
                gap, first = capacity, sequences
                n = ceil(left[x] / (capacity // x))
                sequences += n
            each = gap // x  # once the tightest, a sequence stays the tightest until it is full
            wide = min(n, left[x] // each)
            if wide:
                put(x, wide * each, wide, first, capacity - gap)
                open_gap(first, wide, gap - each * x)
                open_gap(first + wide, n - wide, gap)
            else:
                few = left[x]
                put(x, few, 1, first, capacity - gap)
                open_gap(first, 1, gap - few * x)
                open_gap(first + 1, n - 1, gap)
    return entries, sequences


def best_plan(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[list, int]:
    return min((plan(counts, groups, max(1, int(share * capacity)), capacity) for share, groups in SCHEMES), key=lambda p: p[1])


def plans(counts: DataFrame, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Of (_window, length, count): entries with the window before them, sorted; and per window its first sequence, how many it
    has, and the step by which they are numbered. Windows are planned side by side."""
    fields = ["_window", "length", "low", "wide", "sequence", "offset"]

    def work(table: pa.Table) -> pa.Table:
        window = table.column("_window")[0].as_py()
        entries, n = best_plan(dict(zip(table.column("length").to_pylist(), table.column("count").to_pylist(), strict=True)), capacity)
        rows = np.array([(window, *e) for e in [*entries, (-1, 0, 0, n, 0)]], np.int64)
        return pa.table([pa.array(c) for c in rows.T], names=fields)

    made = counts.groupBy("_window").applyInArrow(work, ", ".join(f"{f} long" for f in fields)).toArrow()  # bounded by windows and the capacity
    rows = np.array([made.column(f).to_numpy() for f in fields], np.int64).T.reshape(-1, 6)
    rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
    last = rows[:, 1] < 0
    windows, base = np.zeros((int(rows[-1, 0]) + 1 if len(rows) else 0, 3), np.int64), 0
    for window, n in rows[last][:, [0, 4]].tolist():
        # Plans have the long pieces first; a step near the golden section of n, without a common factor, spreads them.
        step = next(x for x in range(max(1, round(0.618 * n)), 2 * n + 2) if gcd(x, n) == 1)
        windows[window], base = (base, n, step), base + n
    return rows[~last], windows


def pack(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str | None = None, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text", order_col: str | None = None) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids: ``sequences`` joins them)."""
    if order_col:
        most = docs.agg(F.max(order_col)).first()[0] or 0
        size = max(WINDOW, ceil((most + 1) / WINDOWS))
        keyed = docs.select(F.struct(F.col(id_col).alias("id"), F.col(order_col).cast("long").alias("place")).alias("doc_id"), text_col)
        made = pieces_of(keyed, capacity, tokenizer, with_ids, "doc_id", text_col)
        pieces = made.select(F.col("doc_id.id").alias("doc_id"), *made.columns[1:], F.col("doc_id.place").alias("_place"), F.floor(F.col("doc_id.place") / size).alias("_window"))
        order, spread = [F.col("_place")], F.floor(F.col("_place") % size * PARTS / size)
    else:
        pieces = pieces_of(docs, capacity, tokenizer, with_ids, id_col, text_col).withColumn("_window", F.lit(0).cast("long"))
        order, spread = [], F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(256))  # a hot length spreads over 256 buckets
    pieces = written(pieces)
    table, windows = plans(pieces.groupBy("_window", "length").count(), capacity)
    if not order_col:
        windows[:, 2] = 1
    rows = ranked(pieces, ["_window", "length"], [*order, F.col("doc_id"), F.col("piece"), F.col("start"), F.col("ids_crc32")], spread, "_rank")
    shared = docs.sparkSession.sparkContext.broadcast((table, windows))
    schema = rows.drop("_rank", "_window", "_place").withColumn("sequence_id", F.lit(0).cast("long")).withColumn("offset", F.lit(0).cast("long")).schema

    def place(batches):
        entry, numbers = shared.value
        coded = lambda window, length, rank: (window * (capacity + 1) + length) << 40 | rank  # noqa: E731  # ranks stay below 2 ** 40
        key = coded(*entry[:, :3].T)
        for batch in batches:
            window, length, rank = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("_window", "length", "_rank"))
            e = entry[np.searchsorted(key, coded(window, length, rank), side="right") - 1] if len(entry) else entry[:0]
            base, n, step = numbers[window].T
            away = rank - e[:, 2]
            sequence = base + (e[:, 4] + away % e[:, 3]) * step % n
            keep = schema.names[:-2]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in keep), pa.array(sequence), pa.array(e[:, 5] + away // e[:, 3] * length)],
                names=[*keep, "sequence_id", "offset"],
            )

    return rows.mapInArrow(place, schema)


def sequences(docs: DataFrame, **options) -> DataFrame:
    """Per sequence: sequence_id, ids (all tokens in order), and pieces array<struct<offset, doc_id, piece, start, length>>.

    ``options``: as ``pack`` has them. A sequence holds at most ``capacity`` tokens, so a group is bounded.
    """
    rows = pack(docs, with_ids=True, **options)
    own = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "piece", "start", "length", "ids")))
    pieces = F.transform("own", lambda p: p.dropFields("ids"))
    made = rows.groupBy("sequence_id").agg(own.alias("own")).select("sequence_id", F.col("own.ids").alias("ids"), pieces.alias("pieces"))
    schema = made.withColumn("ids", F.array().cast("array<int>")).schema

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                ids = [np.concatenate([unpacked(x) for x in own]) for own in part.column("ids").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("sequence_id"), pa.array(ids, pa.list_(pa.int32())), part.column("pieces")], names=["sequence_id", "ids", "pieces"])

    return made.mapInArrow(run, schema)


def digest(docs: DataFrame) -> DataFrame:
    """What the query op4 returns."""
    return pack(docs)
