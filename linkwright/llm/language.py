"""Language of texts (operator 6): a linear-chain conditional random field over words.

Each word has affix, character n-gram and lexicon features; transitions between the languages of neighbouring words are
learned with them. Training sequences mix stretches of words from texts of several languages, so that the transitions
know code-switching. Prediction runs forward-backward over each line; a text's language is that with the largest sum of
marginals over its words, and its score is that sum's share.

Training takes a sample of labelled texts whose size is bounded: at most ``per_language`` texts (by hash of the id) of each
label, whichever labels there are. Everything else reads all rows.

Defined results: a null text, or one without letters, is ``und`` with score 0; without any labelled text everything is
``und``; an empty table gives an empty table; repeated rows and ids are each treated alone; rows with a null id or label
are predicted but not learned from; ties go to the label that sorts first; other columns are not read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkwright.llm.common import map_text, small_batches

WORD = re.compile(r"[^\W\d_]+")
PER_LANGUAGE = 60
LEXICON_LEAST = 3  # a word is a feature of its own from so many places in the sample
SEQUENCE, ROUNDS, STEP, DECAY = 24, 40, 0.5, 1e-4
CACHE = 100_000  # words whose emissions a task keeps
TEXTS = 512  # texts whose words stand in memory at the same time, where documents are filtered


def features(word: str) -> list[str]:
    """Names of a word's features: the word, its first and last letters, its trigrams with both ends marked."""
    w = f"^{word}$"
    return [f"={word}", w[:4], w[-4:], *map("".join, zip(w, w[1:], w[2:]))]


class Field:
    """A trained field: labels, feature rows, emission and transition weights."""

    def __init__(self, labels: list[str], index: dict[str, int], weights: np.ndarray, moves: np.ndarray, starts: np.ndarray) -> None:
        self.labels, self.index, self.weights, self.moves, self.starts = labels, index, weights, moves, starts

    def parts(self) -> tuple:
        """What makes the field again; plain data, so that any worker can read it."""
        return self.labels, self.index, self.weights, self.moves, self.starts

    def emissions(self, words: list[str]) -> np.ndarray:
        if not words:
            return np.zeros((0, len(self.labels)), np.float32)
        get, none, flat = self.index.get, len(self.index), []
        for w in words:
            flat += [get(f, none) for f in features(w)]  # features that training didn't see weigh nothing
        sizes = np.fromiter(map(len, words), np.int64, len(words)) + 3
        return np.add.reduceat(np.vstack([self.weights, np.zeros_like(self.weights[:1])])[flat], np.cumsum(sizes) - sizes, axis=0)


class Places(dict):
    """Gives each word the next number when it is first asked for."""

    def __init__(self) -> None:
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        self.new.append(word)
        return n


def forward_backward(emit: np.ndarray, begin: np.ndarray, length: np.ndarray, moves: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of every word of many sequences: marginals, forward vectors, and backward vectors times emissions, the latter two scaled.

    Sequence i is emit[begin[i]:begin[i] + length[i]], lengths falling. Works on all sequences at a time, place by place.
    """
    e = np.exp(emit - emit.max(1, keepdims=True))
    step, first = np.exp(moves), np.exp(starts)
    alpha, ahead = np.empty_like(e), np.empty_like(e)
    longest = int(length[0]) if len(length) else 0
    active = np.searchsorted(-length, -np.arange(1, longest + 1), side="right")
    last = None
    for t in range(longest):
        at = begin[: active[t]] + t
        a = e[at] * (first if last is None else last[: active[t]] @ step)
        a /= a.sum(1, keepdims=True)
        alpha[at] = last = a
    after = None
    for t in range(longest - 1, -1, -1):
        at = begin[: active[t]] + t
        b = e[at]
        if after is not None:
            b[: len(after)] *= after @ step.T
        b /= b.sum(1, keepdims=True)
        ahead[at] = after = b
    both = alpha * ahead / np.maximum(e, 1e-30)
    both /= both.sum(1, keepdims=True)
    return both, alpha, ahead


def train(samples: list[tuple[str, str]], seed: int = 7) -> Field | None:
    """Fits the field to (text, language) pairs by adaptive gradient steps on the log-likelihood of mixed sequences."""
    words = [(WORD.findall(text.lower()), lang) for text, lang in samples]
    words = [(w, lang) for w, lang in words if w]
    labels = sorted({lang for _, lang in words})
    if not labels:
        return None
    rng = np.random.default_rng(seed)
    counts = Counter(w for ws, _ in words for w in ws)
    types = sorted(counts)
    place = {w: i for i, w in enumerate(types)}
    index: dict[str, int] = {}
    rows, sizes = [], []
    for w in types:
        own = [f for f in features(w) if f[0] != "=" or counts[w] >= LEXICON_LEAST]
        rows += [index.setdefault(f, len(index)) for f in own]
        sizes.append(len(own))
    rows, sizes = np.array(rows), np.array(sizes)
    edges = np.cumsum(sizes) - sizes
    of_type = np.repeat(np.arange(len(types)), sizes)
    # Stretches of 3 to SEQUENCE words; every language gives as many words, and the order of stretches is random.
    n, by = len(labels), {lang: [] for lang in labels}
    for ws, lang in words:
        by[lang] += [place[w] for w in ws]
    most = max(map(len, by.values()))
    pieces = []
    for k, lang in enumerate(labels):
        own, at = (by[lang] * (most // len(by[lang]) + 1))[:most], 0
        while at < len(own):
            size = int(rng.integers(3, 2 * SEQUENCE))
            pieces.append((own[at : at + size], k))
            at += size
    stream = [(w, pieces[i][1]) for i in rng.permutation(len(pieces)) for w in pieces[i][0]]
    x, y = np.array([s[0] for s in stream]), np.array([s[1] for s in stream])
    begin = np.arange(0, len(x), SEQUENCE)
    length = np.minimum(SEQUENCE, len(x) - begin)
    inner = np.ones(len(x), bool)
    inner[begin] = False
    inner = np.flatnonzero(inner)
    weights, moves, starts = np.zeros((len(index), n), np.float64), np.zeros((n, n)), np.zeros(n)
    grown = [np.full_like(p, 1e-6) for p in (weights, moves, starts)]
    truth = np.zeros((len(x), n))
    truth[np.arange(len(x)), y] = 1
    seen = np.bincount(y[inner - 1] * n + y[inner], minlength=n * n).reshape(n, n)
    for _ in range(ROUNDS):
        emit = np.add.reduceat(weights[rows], edges, axis=0)[x]
        marginal, alpha, ahead = forward_backward(emit, begin, length, moves, starts)
        error = truth - marginal
        by_type = np.stack([np.bincount(x, error[:, k], len(types)) for k in range(n)], 1)
        slope = np.stack([np.bincount(rows, by_type[of_type, k], len(index)) for k in range(n)], 1)
        pair = alpha[inner - 1][:, :, None] * np.exp(moves)[None] * ahead[inner][:, None, :]
        pair /= pair.sum((1, 2), keepdims=True)
        slopes = (slope / len(x) - DECAY * weights / len(x), (seen - pair.sum(0)) / len(x), error[begin].sum(0) / len(x))
        for p, g, total in zip((weights, moves, starts), slopes, grown, strict=True):
            total += g * g
            p += STEP * g / np.sqrt(total)
    return Field(labels, index, weights.astype(np.float32), moves.astype(np.float32), starts.astype(np.float32))


class Tagger:
    """Marginals of the words of texts, with a bounded cache of emissions by word."""

    def __init__(self, field: Field) -> None:
        self.field, self.place, self.size, self.known = field, Places(), 0, np.zeros((0, len(field.labels)), np.float32)

    def marginals(self, lines: list[list[str]]) -> np.ndarray:
        """A row for each word of the lines, in their order; lines are not empty."""
        flat = [w for line in lines for w in line]
        if len(self.place) > CACHE:
            self.place, self.size = Places(), 0
        at = np.fromiter(map(self.place.__getitem__, flat), np.int64, len(flat))
        if new := self.place.new:
            self.place.new, size = [], self.size
            self.size += len(new)
            if self.size > len(self.known):
                self.known = np.vstack([self.known[:size], np.zeros((2 * self.size - size, len(self.field.labels)), np.float32)])
            self.known[size : self.size] = self.field.emissions(new)
        emit = self.known[at]
        length = np.fromiter(map(len, lines), np.int64, len(lines))
        begin = np.cumsum(length) - length
        order = np.argsort(-length, kind="stable")
        return forward_backward(emit, begin[order], length[order], self.field.moves, self.field.starts)[0]

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        lines, owner = [], []
        for i, text in enumerate(texts):
            for line in (text or "").lower().split("\n"):
                if (words := WORD.findall(line)) and (line.isascii() or any(c.isalpha() for c in line)):
                    lines.append(words)
                    owner.append(i)
        out = [("und", 0.0)] * len(texts)
        if lines:
            sums = np.add.reduceat(self.marginals(lines), np.cumsum([0, *map(len, lines[:-1])]), axis=0, dtype=np.float64)
            which, at = np.unique(owner, return_index=True)
            for i, total in zip(which, np.add.reduceat(sums, at, axis=0), strict=True):
                best = int(total.argmax())
                out[i] = (self.field.labels[best], float(min(1.0, total[best] / total.sum())))
        return out


def sample(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE) -> list[tuple[str, str]]:
    """The training sample: (text, language) of rows whose crc32 of the id, modulo 4, is not 2.

    Its bound is ``per_language`` whole texts of every label there is; labels are counted over all rows.
    """
    learn = docs.where((F.crc32(F.col(id_col).cast("string")) % 4 != 2) & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    learn = learn.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    draw, full = F.pmod(F.xxhash64(F.col("id").cast("string"), F.lit("sample")), F.lit(1 << 30)), 1 << 30
    counts = learn.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))  # a row a label
    # About 5/4 of the bound are drawn, and a few more of rare labels, so that what each task sends on is small.
    most = F.least(F.lit(1.0), (1.25 * per_language + 20) / F.col("n")) * full
    got = learn.withColumn("draw", draw).join(F.broadcast(counts), "lang").where(F.col("draw") < most).select("id", "text", "lang", "draw").collect()
    taken: Counter = Counter()
    out = []
    for row in sorted(got, key=lambda r: (r["lang"], r["draw"], str(r["id"]), r["text"])):
        if taken[row["lang"]] < per_language:
            taken[row["lang"]] += 1
            out.append((row["text"], row["lang"]))
    return out


def fit(docs: DataFrame, **options) -> Field | None:
    return train(sample(docs, **options))


def predict(docs: DataFrame, field: Field | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, lang_pred, score. ``field`` is broadcast; the bounded sample bounds it."""
    shared = docs.sparkSession.sparkContext.broadcast(field and field.parts())

    def make():
        model = shared.value
        return Tagger(Field(*model)).predict if model else lambda texts: [("und", 0.0)] * len(texts)

    return map_text(docs, make, "lang_pred string, score double", id_col, text_col, rows=1024)


def accepted(docs: DataFrame, field: Field | None, least: float, text_col: str = "text") -> DataFrame:
    """``docs`` without the rows whose text is ``und`` or whose language scores below ``least``."""
    shared = docs.sparkSession.sparkContext.broadcast(field and field.parts())

    small_batches(docs.sparkSession)

    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = shared.value
        tagger = Tagger(Field(*model)) if model else None
        for texts in batches:
            got = []
            for at in range(0, len(texts), TEXTS):
                own = texts.slice(at, TEXTS).to_pylist()
                got += tagger.predict(own) if tagger else [("und", 0.0)] * len(own)
            yield pa.array([-1.0 if lang == "und" else s for lang, s in got], pa.float64())

    return docs.withColumn("_score", score(F.col(text_col).cast("string"))).where(F.col("_score") >= least).select(*docs.columns)


def label_spans(docs: DataFrame, field: Field, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id and runs array<struct<lang, start, end>> of neighbouring words of one language, for code-switched text."""
    shared = docs.sparkSession.sparkContext.broadcast(field.parts())

    def make():
        tagger = Tagger(Field(*shared.value))

        def work(texts):
            out = []
            for text in texts:
                runs, at = [], 0
                for line in (text or "").split("\n"):
                    if places := [(m.start() + at, m.end() + at, m[0].lower()) for m in WORD.finditer(line)]:
                        for (start, end, _), k in zip(places, tagger.marginals([[p[2] for p in places]]).argmax(1), strict=True):
                            lang = tagger.field.labels[k]
                            if runs and runs[-1]["lang"] == lang:
                                runs[-1]["end"] = end
                            else:
                                runs.append({"lang": lang, "start": start, "end": end})
                    at += len(line) + 1
                out.append((runs,))
            return out

        return work

    return map_text(docs, make, "runs array<struct<lang:string,start:bigint,end:bigint>>", id_col, text_col)


def digest(docs: DataFrame) -> DataFrame:
    """What the query op6 returns."""
    got = predict(docs, fit(docs))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    return got.select("doc_id", held.alias("held_out"), "lang_pred", "score")


def held_out(doc_id) -> bool:
    """The same remainder by hand, for tests."""
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 4 == 2
