"""String-similarity kernels: one Arrow UDF a pair of columns, exact and bit-parallel.

The functions of two strings define the kernels. ``compare_all`` gives the same numbers for many pairs at once: strings become
rows of letter codes, and each step of a recurrence is a few NumPy operations on one 64-bit word a pair (two or more for strings
above 64 letters).
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column
from pyspark.sql import functions as F


def common_subsequence(a: str, b: str) -> int:
    """Length of the longest common subsequence, with a row of the table in one integer."""
    if not a or not b:
        return 0
    full = (1 << len(a)) - 1
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    state = full
    for c in b:
        match = state & where.get(c, 0)
        state = ((state + match) | (state - match)) & full
    return len(a) - state.bit_count()


def ratio(a: str, b: str) -> float:
    """200 * LCS / total length; 100 for two empty strings."""
    total = len(a) + len(b)
    return 200.0 * common_subsequence(a, b) / total if total else 100.0


def token_sort_ratio(a: str, b: str) -> float:
    return ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def token_set_ratio(a: str, b: str) -> float:
    """The best ratio among common tokens, and these with either side's rest; 100 if one side adds nothing, 0 without tokens."""
    one, two = set(a.split()), set(b.split())
    if not one or not two:
        return 0.0
    both, left, right = " ".join(sorted(one & two)), " ".join(sorted(one - two)), " ".join(sorted(two - one))
    if both and (not left or not right):
        return 100.0
    first, second = (f"{both} {x}".strip() for x in (left, right))
    return max(ratio(first, second), *(ratio(both, x) for x in (first, second))) if both else ratio(first, second)


def partial_ratio(a: str, b: str) -> float:
    """The best ratio of the shorter string with any window of its length in the longer one, cut ones at the ends included."""
    if len(a) == len(b):
        return max(_windows(a, b), _windows(b, a))
    return _windows(a, b) if len(a) < len(b) else _windows(b, a)


def _windows(short: str, long: str) -> float:
    """Windows by the falling number of letters that they share with the short string, until no other can be better."""
    if not short or not long:
        return 100.0 if not short and not long else 0.0
    n, free, shared, bounds = len(short), Counter(short), 0, []
    for start in range(1 - n, len(long)):
        if start + n <= len(long):
            shared += free[long[start + n - 1]] > 0
            free[long[start + n - 1]] -= 1
        if start > 0:
            free[long[start - 1]] += 1
            shared -= free[long[start - 1]] > 0
        size = min(len(long), start + n) - max(0, start)
        bounds.append((200.0 * shared / (n + size), start))
    best = 0.0
    for bound, start in sorted(bounds, reverse=True):
        if bound <= best:
            break
        best = max(best, ratio(short, long[max(0, start) : start + n]))
    return best


def jaro(a: str, b: str) -> float:
    if not a and not b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    taken, first = [False] * len(b), []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not taken[j] and b[j] == c:
                taken[j] = True
                first.append(c)
                break
    if not first:
        return 0.0
    second = [c for c, t in zip(b, taken, strict=True) if t]
    m, moved = len(first), sum(x != y for x, y in zip(first, second, strict=True)) // 2
    return (m / len(a) + m / len(b) + (m - moved) / m) / 3


def jaro_winkler(a: str, b: str) -> float:
    """Jaro, raised by a tenth of what lacks to 1 for each of up to four common first letters where it exceeds 0.7."""
    value = jaro(a, b)
    prefix = 0
    while prefix < min(4, len(a), len(b)) and a[prefix] == b[prefix]:
        prefix += 1
    return value + 0.1 * prefix * (1 - value) if value > 0.7 else value


KERNELS = {"ratio": ratio, "tset": token_set_ratio, "tsort": token_sort_ratio, "partial": partial_ratio, "jw": jaro_winkler}

#: Pairs are taken in so many cells of letters or of windows at a time, which bounds memory; longer strings go one by one.
CELLS, LONGEST = 1 << 16, 512


class Texts:
    """The distinct strings of a batch as rows of letter codes, which begin at 1; 0 is no letter."""

    def __init__(self, texts: list[str]) -> None:
        import numpy as np

        self.number = {t: i for i, t in enumerate(dict.fromkeys(texts))}
        self.all = list(self.number)
        self.size = np.fromiter(map(len, self.all), np.int64, len(self.all))
        letters = np.frombuffer("".join(self.all).encode("utf-32-le", "surrogatepass"), np.uint32)
        number = np.cumsum(np.bincount(letters) > 0)  # at most as many as there are code points
        self.codes, self.letters = np.r_[number[letters], 0], int(number[-1]) + 1 if len(letters) else 1
        self.start = np.cumsum(self.size) - self.size

    def rows(self, i, width: int, backwards: bool = False):
        """Codes of the strings ``i``, a column each, filled up with 0."""
        import numpy as np

        at, size = np.arange(width)[:, None], self.size[i]
        place = self.start[i] + (size - 1 - at if backwards else at)
        return self.codes[np.where(at < size, place, len(self.codes) - 1)]


def _chunks(cost, order):
    """Slices of ``order`` of at most CELLS cells each, where every pair costs as much as the largest one."""
    begin, most = 0, 0
    for end, own in enumerate(cost[order].tolist()):
        most = max(most, own)
        if end > begin and most * (end + 1 - begin) > CELLS:
            yield order[begin:end]
            begin, most = end, own
    if begin < len(order):
        yield order[begin:]


def _masks(texts: Texts, a, b, backwards: bool = False):
    """[word, letter of b, pair]: the places in a of that letter as bits; and a's bits, [word, pair]."""
    import numpy as np

    size, n = texts.size[a], len(a)
    words = max(1, -(-int(size.max()) // 64))
    mine, other = (texts.rows(x, int(texts.size[x].max()), backwards) for x in (a, b))
    letters = texts.letters
    if letters > 64:  # those of these pairs
        found, used = np.unique(np.r_[0, mine.ravel(), other.ravel()], return_inverse=True)
        mine, other, letters = used[1 : 1 + mine.size].reshape(mine.shape), used[1 + mine.size :].reshape(other.shape), len(found)
    where, pair = np.zeros((words, n * letters), np.uint64), np.arange(n) * letters
    for i, at in enumerate(pair + mine):
        where[i // 64, at] |= np.uint64(1 << i % 64)
    where[:, pair] = 0  # no letter
    left = np.clip(size - 64 * np.arange(words)[:, None], 0, 64)
    full = np.where(left == 64, np.uint64(2**64 - 1), (np.uint64(1) << np.minimum(left, 63).astype(np.uint64)) - np.uint64(1))
    return np.stack([w.take(pair + other) for w in where]), full


def _step(state, mask) -> None:
    """A letter of the other string, for all pairs; ``state`` is a list of words, the lowest first."""
    carry = None
    for w, s in enumerate(state):
        met = s & mask[w]
        added = s + met
        if len(state) > 1:
            over = added < s
            if carry is not None:
                added += carry
                over |= added < carry
            carry = over.astype(met.dtype)
        s ^= met  # letters that are met lie in the state
        s |= added


def _common(state, full):
    """How many bits of ``full`` the state lacks."""
    import numpy as np

    return sum(np.bitwise_count(f & ~s).astype(np.int64) for s, f in zip(state, full, strict=True))


def _subsequences(texts: Texts, a, b):
    """Lengths of the longest common subsequences of the pairs of strings a[i], b[i]."""
    import numpy as np

    swap = texts.size[a] > texts.size[b]
    a, b = np.where(swap, b, a), np.where(swap, a, b)
    out = np.zeros(len(a), np.int64)
    short, long = texts.size[a], texts.size[b]
    equal = a == b
    out[equal] = short[equal]
    rest = np.flatnonzero(~equal & (short > 0))
    big = short[rest] > LONGEST
    for i in rest[big]:
        out[i] = common_subsequence(texts.all[a[i]], texts.all[b[i]])
    rest = rest[~big]
    order = rest[np.lexsort((short[rest], long[rest], (short[rest] - 1) // 64))]
    for part in _chunks(long * -(-short // 64), order):
        masks, full = _masks(texts, a[part], b[part])
        state = list(full.copy())
        for j in range(masks.shape[1]):
            _step(state, masks[:, j])
        out[part] = _common(state, full)
    return out


def _ratios(common, total):
    import numpy as np

    return np.where(total > 0, 200.0 * common / np.maximum(total, 1), 100.0)


def _all_windows(texts: Texts, a, b):
    """``_windows`` of the pairs of strings a[i] and b[i], of which the first is not the longer one."""
    import numpy as np

    n, size = texts.size[a], texts.size[b]
    out = np.where((n == 0) & (size == 0), 100.0, 0.0)
    rest = np.flatnonzero(n > 0)
    big = size[rest] > LONGEST
    for i in rest[big]:
        out[i] = _windows(texts.all[a[i]], texts.all[b[i]])
    rest = rest[~big]
    windows = size - n + 1
    order = rest[np.lexsort((-n[rest], windows[rest] // 4, (n[rest] - 1) // 64))]
    for part in _chunks(np.maximum(windows, size) * -(-n // 64), order):
        part = part[np.argsort(-n[part], kind="stable")]  # so that the strings with a letter j are the first ones
        many, most = n[part], int(windows[part].max())
        masks, full = _masks(texts, a[part], b[part])
        longer = np.searchsorted(-many, -np.arange(many[0]), side="left")  # how many have more than j letters
        # Whole windows: all that begin anywhere move on together.
        wide = np.zeros((masks.shape[0], int(many[0]) + most, len(part)), np.uint64)
        wide[:, : masks.shape[1]] = masks[:, : wide.shape[1]]
        state = [np.repeat(f[None], most, 0) for f in full]
        for j, k in enumerate(longer.tolist()):
            _step([s[:, :k] for s in state], wide[:, j : j + most, :k])
        whole = _common(state, full[:, None])
        whole[np.arange(most)[:, None] >= windows[part]] = 0
        best = _ratios(whole.max(0), 2 * many)
        # Cut ones: beginnings of the longer string, and endings, which are beginnings of both turned round.
        for backwards in (False, True):
            if backwards:
                masks, full = _masks(texts, a[part], b[part], True)
            state = list(full.copy())
            for j, k in enumerate(longer[1:].tolist()):  # of j + 1 letters, fewer than the shorter string has
                some = [s[:k] for s in state]
                _step(some, masks[:, j, :k])
                best[:k] = np.maximum(best[:k], _ratios(_common(some, full[:, :k]), many[:k] + j + 1))
        out[part] = best
    return out


def _all_partial(texts: Texts, a, b):
    import numpy as np

    swap = texts.size[a] > texts.size[b]
    short, long = np.where(swap, b, a), np.where(swap, a, b)
    out, same = _all_windows(texts, short, long), np.flatnonzero((texts.size[a] == texts.size[b]) & (a != b))
    out[same] = np.maximum(out[same], _all_windows(texts, long[same], short[same]))
    return out


def _all_token_sets(pairs: list[tuple[str, str]]):
    """The common tokens are a common beginning, so that only the rests are compared."""
    import numpy as np

    tokens = {t: set(t.split()) for t in {t for p in pairs for t in p}}
    out, found, rests = np.zeros(len(pairs)), [], []
    for i, (a, b) in enumerate(pairs):
        one, two = tokens[a], tokens[b]
        if not one or not two:
            continue
        both = one & two
        if both and (len(both) == len(one) or len(both) == len(two)):
            out[i] = 100.0
            continue
        found.append((i, sum(map(len, both)) + len(both)))  # with the blank after each token
        rests.append((" ".join(sorted(one - both)), " ".join(sorted(two - both))))
    if found:
        place, head = np.array(found).T
        texts, left, right = _numbered(rests)
        first, second = head + texts.size[left], head + texts.size[right]
        value = _ratios(head + _subsequences(texts, left, right), first + second)
        alone = np.maximum(_ratios(head - 1, head - 1 + first), _ratios(head - 1, head - 1 + second))
        out[place] = np.where(head > 0, np.maximum(value, alone), value)
    return out


def _all_jaro_winkler(texts: Texts, a, b):
    import numpy as np

    out, la, lb = np.zeros(len(a)), texts.size[a], texts.size[b]
    big = np.maximum(la, lb) > 64
    for i in np.flatnonzero(big):
        out[i] = jaro_winkler(texts.all[a[i]], texts.all[b[i]])
    out[(la == 0) & (lb == 0)] = 1.0
    rest = np.flatnonzero(~big & (la > 0) & (lb > 0))
    one, bits = np.uint64(1), lambda k: np.where(k >= 64, np.uint64(2**64 - 1), (one << np.clip(k, 0, 63).astype(np.uint64)) - one)
    for part in _chunks(np.full(len(a), 64), rest[np.argsort(la[rest], kind="stable")]):
        x, y, m, n = a[part], b[part], la[part], lb[part]
        masks, _ = _masks(texts, y, x)
        reach = np.maximum(0, np.maximum(m, n) // 2 - 1)
        free, hit = bits(n), np.zeros((masks.shape[1], len(part)), bool)
        for i in range(len(hit)):
            near = masks[0, i] & free & bits(i + reach + 1) & ~bits(i - reach)
            free ^= near & (~near + one)  # the first
            hit[i] = near != 0
        taken = bits(n) & ~free
        matched = hit.sum(0)
        width = int(n.max())
        first, second = texts.rows(x, len(hit)).T, texts.rows(y, width).T
        apart = first[hit.T] != second[(taken[:, None] >> np.arange(width, dtype=np.uint64)) & one != 0]
        moved = np.bincount(np.repeat(np.arange(len(part)), matched)[apart], minlength=len(part)) // 2
        k = np.maximum(matched, 1)
        value = np.where(matched > 0, (k / m + k / n + (k - moved) / k) / 3, 0.0)
        four = min(4, first.shape[1], second.shape[1])
        prefix = np.cumprod((first[:, :four] == second[:, :four]) & (first[:, :four] > 0), axis=1).sum(1)
        out[part] = np.where(value > 0.7, value + 0.1 * prefix * (1 - value), value)
    return out


def _numbered(pairs: list[tuple[str, str]]):
    """(texts, numbers of the first strings, numbers of the second ones)."""
    import numpy as np

    texts = Texts([t for p in pairs for t in p])
    return texts, *(np.fromiter((texts.number[p[i]] for p in pairs), np.int64, len(pairs)) for i in (0, 1))


def compare_all(pairs: list[tuple[str, str]], names: tuple[str, ...]) -> dict:
    """The named kernels of all pairs, an array each: what ``KERNELS`` gives for one pair after another."""
    texts, a, b = _numbered(pairs)
    out = {}
    for name in names:
        if name == "ratio":
            out[name] = _ratios(_subsequences(texts, a, b), texts.size[a] + texts.size[b])
        elif name == "tsort":
            ordered = {t: " ".join(sorted(t.split())) for t in texts.all}
            own, x, y = _numbered([(ordered[p], ordered[q]) for p, q in pairs])
            out[name] = _ratios(_subsequences(own, x, y), own.size[x] + own.size[y])
        elif name == "tset":
            out[name] = _all_token_sets(pairs)
        elif name == "partial":
            out[name] = _all_partial(texts, a, b)
        else:
            out[name] = _all_jaro_winkler(texts, a, b)
    return out


def kernels(a: Column, b: Column, *names: str) -> Column:
    """A struct of the named similarities of two strings; equal pairs within a batch are computed once. Nulls count as empty."""

    @F.pandas_udf(", ".join(f"{n} double" for n in names))
    def compare(one, two):
        import numpy as np
        import pandas as pd

        known: dict = {}
        whose = [known.setdefault(pair, len(known)) for pair in zip(one.fillna(""), two.fillna(""), strict=True)]
        made = compare_all(list(known), names) if known else dict.fromkeys(names, np.zeros(0))
        return pd.DataFrame({n: made[n][whose] for n in names})

    return compare(a, b)


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; 0 if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(0.0)
