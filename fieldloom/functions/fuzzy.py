"""Fuzzy string similarity, 0 to 100: ratios of the longest common subsequence.

The scalars are plain functions, for a string at a time; the UDFs take Arrow batches, and a batch's pairs side by side, a
bit of a machine word for each position of the shorter string. ratio_column() is the same ratio as a
column expression, for short strings and as a cross-check.
"""

from __future__ import annotations

import math
from bisect import bisect_left, bisect_right
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence, a bit for each position of a."""
    if len(a) > len(b):
        a, b = b, a
    at: dict[str, int] = {}
    for i, ch in enumerate(a):
        at[ch] = at.get(ch, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for ch in b:
        hit = row & at.get(ch, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def ratio(a: str, b: str) -> float:
    total = len(a) + len(b)
    return 200.0 * lcs(a, b) / total if total else 100.0


def token_sort_ratio(a: str, b: str) -> float:
    return ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def _token_sets(a: str, b: str) -> tuple[str, str, str]:
    x, y = set(a.split()), set(b.split())
    return tuple(" ".join(sorted(part)) for part in (x & y, x - y, y - x))


def token_set_ratio(a: str, b: str) -> float:
    if not a.split() or not b.split():
        return 0.0
    both, left, right = _token_sets(a, b)
    if both and not (left and right):
        return 100.0
    if not both:
        return ratio(left, right)
    one, two = f"{both} {left}", f"{both} {right}"
    return max(ratio(one, two), ratio(both, one), ratio(both, two))


class PhraseIndex:
    """Finds the phrase with the highest token_set_ratio to a line, the first of equals, if it is `least` or more.

    An inverted index gives the phrases that share a token with the line. Without a common token the ratio is that of
    whole strings, which lengths and then counts of characters bound, so few others need a ratio at all. Lines come again
    on other documents: what was found is kept, for a bounded number of lines of a bounded length.
    """

    KEPT, LONGEST = 100_000, 100

    def __init__(self, phrases: list[str], least: float):
        self.phrases, self.least = phrases, least
        self.holding: dict[str, set[int]] = {}
        for i, p in enumerate(phrases):
            for token in p.split():
                self.holding.setdefault(token, set()).add(i)
        bare = [" ".join(set(p.split())) for p in phrases]
        self.by_size = sorted((len(p), i) for i, p in enumerate(bare))
        self.sizes = [n for n, _ in self.by_size]
        self.letters = [Counter(p) for p in bare]
        self.known: dict[str, int | None] = {}

    def _alike(self, words: set[str]) -> set[int]:
        """Phrases that can score enough by their letters alone."""
        line = " ".join(words)
        n, slack = len(line), 200.0 / self.least - 1 if self.least else math.inf
        fits = self.by_size[bisect_left(self.sizes, n / slack - 1e-9) : bisect_right(self.sizes, n * slack + 1e-9)]
        letters = Counter(line)
        return {i for size, i in fits if 200.0 * (letters & self.letters[i]).total() >= self.least * (n + size) - 1e-9}

    def best(self, line: str) -> int | None:
        if len(line) > self.LONGEST:
            return self._search(line)
        if line not in self.known:
            if len(self.known) >= self.KEPT:
                self.known.clear()
            self.known[line] = self._search(line)
        return self.known[line]

    def _search(self, line: str) -> int | None:
        words = set(line.split())
        some = self._alike(words).union(*[self.holding[w] for w in words if w in self.holding])
        top, found = max(((token_set_ratio(self.phrases[i], line), -i) for i in some), default=(0.0, 0))
        return -found if some and top >= self.least and top > 0 else None


def partial_ratio(a: str, b: str) -> float:
    """Best ratio of the shorter string with any window of its length in the longer, cut off at the ends, too."""
    if len(a) > len(b):
        a, b = b, a
    if not a:
        return 0.0 if b else 100.0
    if a in b:
        return 100.0

    def best(x: str, y: str) -> float:
        n, top = len(x), 0.0
        for end in range(1, len(y) + n):
            part = y[max(0, end - n) : end]
            if 200.0 * min(len(part), n) / (n + len(part)) > top:
                top = max(top, ratio(x, part))
        return top

    return max(best(a, b), best(b, a)) if len(a) == len(b) else best(a, b)


def partial_token_ratio(a: str, b: str) -> float:
    both, left, right = _token_sets(a, b)
    if both:
        return 100.0
    return max(partial_ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split()))), partial_ratio(left, right))


def weighted_ratio(a: str, b: str) -> float:
    """Best of the ratios, those of parts scaled down, the more so for very different lengths."""
    if not a or not b:
        return 0.0
    times = max(len(a), len(b)) / min(len(a), len(b))
    whole = ratio(a, b)
    if times < 1.5:
        return max(whole, 0.95 * max(token_sort_ratio(a, b), token_set_ratio(a, b)))
    scale = 0.9 if times <= 8 else 0.6
    return max(whole, scale * partial_ratio(a, b), 0.95 * scale * partial_token_ratio(a, b))


RATIOS = {"ratio": ratio, "token_sort_ratio": token_sort_ratio, "token_set_ratio": token_set_ratio, "partial_ratio": partial_ratio, "weighted_ratio": weighted_ratio}

# The same over many pairs at once


def _codes(texts: list[str], width: int, kind: np.dtype, pad: int) -> np.ndarray:
    """A row of code points a text, filled up to width."""
    out = np.full((len(texts), width), pad, kind)
    sizes = np.fromiter(map(len, texts), int, len(texts))
    out[np.arange(width) < sizes[:, None]] = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    return out


def _masks(a: list[str], b: list[str], lane: int) -> np.ndarray:
    """For each pair and position of b, the positions of a with the same letter, as bits of one word or, if lane is over 64, several."""
    top = max(max(map(max, filter(None, side)), default="") for side in (a, b))
    kind = np.dtype("u1" if top < "\u00fe" else "u4")
    most = np.iinfo(kind).max
    x, y = _codes(a, lane, kind, most), _codes(b, max(map(len, b)), kind, most - 1)
    return np.packbits(x[:, None, :] == y[:, :, None], axis=2, bitorder="little").view(f"u{min(lane, 64) // 8}")


def _lcs_block(a: list[str], b: list[str], lane: int) -> np.ndarray:
    """lcs() of pairs whose a fits in `lane` bits (8, 16, 32 or a multiple of 64), a step for each position of the b's."""
    hits = _masks(a, b, lane)
    row = np.full((len(a), hits.shape[2]), np.iinfo(hits.dtype).max, hits.dtype)
    for j in range(hits.shape[1]):
        used = hits[:, j] & row
        rest = row - used
        if row.shape[1] == 1:
            row = (row + used) | rest
            continue
        carry = np.zeros(len(a), hits.dtype)
        for w in range(row.shape[1]):  # words of a long string, from the lowest on
            half = row[:, w] + used[:, w]
            full = half + carry
            carry = ((half < used[:, w]) | (full < carry)).astype(hits.dtype)
            row[:, w] = full | rest[:, w]
    return lane - np.bitwise_count(row).sum(1, dtype=int)


def _lane(size: int) -> int:
    return next((n for n in (8, 16, 32) if size <= n), -(-size // 64) * 64)


def lcs_many(a: list[str], b: list[str]) -> np.ndarray:
    """lcs() of each pair, a bit a position of the shorter string: a lane of a machine word for each pair, words chained for long ones."""
    pairs = [(x, y) if len(x) <= len(y) else (y, x) for x, y in zip(a, b, strict=True)]
    groups: dict[tuple[int, int], list[int]] = {}
    for i, (x, y) in enumerate(pairs):
        if x:
            groups.setdefault((_lane(len(x)), len(y).bit_length()), []).append(i)
    out = np.zeros(len(pairs), int)
    for (lane, size), at in groups.items():
        step = max(1, (1 << 22) // (lane << size))
        for k in range(0, len(at), step):
            some = at[k : k + step]
            out[some] = _lcs_block([pairs[i][0] for i in some], [pairs[i][1] for i in some], lane)
    return out


def ratio_many(a: list[str], b: list[str]) -> np.ndarray:
    total = np.array([len(x) + len(y) for x, y in zip(a, b, strict=True)])
    return np.where(total > 0, 200.0 * lcs_many(a, b) / np.maximum(total, 1), 100.0)


def _sorted_tokens(texts: list[str]) -> list[str]:
    return [" ".join(sorted(t.split())) for t in texts]


def token_sort_ratio_many(a: list[str], b: list[str]) -> np.ndarray:
    return ratio_many(_sorted_tokens(a), _sorted_tokens(b))


def token_set_ratio_many(a: list[str], b: list[str]) -> np.ndarray:
    out, ask = np.zeros(len(a)), []
    for i, (x, y) in enumerate(zip(a, b, strict=True)):
        if not x.split() or not y.split():
            continue
        both, left, right = _token_sets(x, y)
        if both and not (left and right):
            out[i] = 100.0
        elif not both:
            ask.append((i, left, right))
        else:
            one, two = f"{both} {left}", f"{both} {right}"
            ask += [(i, one, two), (i, both, one), (i, both, two)]
    if ask:
        at, x, y = zip(*ask)
        np.maximum.at(out, list(at), ratio_many(list(x), list(y)))
    return out


def _bounds(a: str, b: str) -> list[tuple[float, str]]:
    """(bound, window) of the windows of b that partial_ratio() holds against a: no ratio exceeds what common letters allow."""
    n, left, common, out = len(a), Counter(a), 0, []
    for end in range(1, len(b) + n):
        if end <= len(b) and b[end - 1] in left:
            left[b[end - 1]] -= 1
            common += left[b[end - 1]] >= 0
        if end > n and b[end - n - 1] in left:
            left[b[end - n - 1]] += 1
            common -= left[b[end - n - 1]] > 0
        window = b[max(0, end - n) : end]
        out.append((200.0 * common / (n + len(window)), window))
    return out


def _windows_block(a: list[str], b: list[str], lane: int) -> np.ndarray:
    """Best ratio of each a, 64 letters or fewer, with the windows of its b: one run from each place of b, whose steps are shared by the windows that begin there."""
    hits = _masks(a, b, lane)[:, :, 0]
    size_a, size_b = (np.fromiter(map(len, side), int, len(side)) for side in (a, b))
    steps = int(size_a.max())
    hits = np.pad(hits, ((0, 0), (0, steps)))
    pair = np.repeat(np.arange(len(a)), size_b)
    start = np.arange(len(pair)) - np.repeat(size_b.cumsum() - size_b, size_b)
    window, n = np.minimum(size_a[pair], size_b[pair] - start), size_a[pair]
    row, best, head = np.full(len(pair), np.iinfo(hits.dtype).max, hits.dtype), np.zeros(len(a)), np.flatnonzero(start == 0)
    for j in range(steps):
        used = hits[pair, start + j] & row
        row = np.where(j < n, (row + used) | (row - used), row)
        short = head[j < window[head]]  # windows that the start of b cuts off
        common = lane - np.bitwise_count(row[short]).astype(int)
        best[pair[short]] = np.maximum(best[pair[short]], 200.0 * common / (n[short] + j + 1))
    np.maximum.at(best, pair, 200.0 * (lane - np.bitwise_count(row).astype(int)) / (n + window))
    return best


def partial_ratio_many(a: list[str], b: list[str]) -> np.ndarray:
    """Of long strings, the window with the highest bound first, then only those whose bound is above what it gave; of others, all windows at once."""
    out, open_pairs = np.zeros(len(a)), []
    for i, (x, y) in enumerate(zip(a, b, strict=True)):
        if len(x) > len(y):
            x, y = y, x
        if not x:
            out[i] = 0.0 if y else 100.0
        elif x in y:
            out[i] = 100.0
        else:
            open_pairs += [(i, x, y)] + ([(i, y, x)] if len(x) == len(y) else [])
    groups: dict[tuple[int, int], list[tuple]] = {}
    for p in open_pairs:
        if len(p[1]) <= 64:
            groups.setdefault((_lane(len(p[1])), len(p[2]).bit_length()), []).append(p)
    for (lane, size), some in groups.items():
        step = max(1, (1 << 22) // (lane << size))
        for k in range(0, len(some), step):
            at, x, y = zip(*some[k : k + step])
            np.maximum.at(out, list(at), _windows_block(list(x), list(y), lane))
    long = [(i, x, _bounds(x, y)) for i, x, y in open_pairs if len(x) > 64]
    if long:
        first = [max(w, key=lambda v: v[0])[1] for _, _, w in long]
        np.maximum.at(out, [i for i, _, _ in long], ratio_many([x for _, x, _ in long], first))
        rest = [(i, x, w) for i, x, windows in long for bound, w in windows if bound > out[i] + 1e-9]
        if rest:
            at, x, w = zip(*rest)
            np.maximum.at(out, list(at), ratio_many(list(x), list(w)))
    return out


def _partial_token_ratio_many(a: list[str], b: list[str]) -> np.ndarray:
    sets = [_token_sets(x, y) for x, y in zip(a, b, strict=True)]
    apart = [i for i, (both, _, _) in enumerate(sets) if not both]
    out = np.full(len(a), 100.0)
    if apart:
        whole = partial_ratio_many(_sorted_tokens([a[i] for i in apart]), _sorted_tokens([b[i] for i in apart]))
        out[apart] = np.maximum(whole, partial_ratio_many([sets[i][1] for i in apart], [sets[i][2] for i in apart]))
    return out


def weighted_ratio_many(a: list[str], b: list[str]) -> np.ndarray:
    out = np.zeros(len(a))
    some = [i for i, (x, y) in enumerate(zip(a, b, strict=True)) if x and y]
    times = {i: max(len(a[i]), len(b[i])) / min(len(a[i]), len(b[i])) for i in some}

    def of(at: list[int]) -> tuple[list[str], list[str]]:
        return [a[i] for i in at], [b[i] for i in at]

    near, far = [i for i in some if times[i] < 1.5], [i for i in some if times[i] >= 1.5]
    if near:
        x, y = of(near)
        out[near] = np.maximum(ratio_many(x, y), 0.95 * np.maximum(token_sort_ratio_many(x, y), token_set_ratio_many(x, y)))
    if far:
        x, y = of(far)
        scale = np.array([0.9 if times[i] <= 8 else 0.6 for i in far])
        out[far] = np.maximum.reduce([ratio_many(x, y), scale * partial_ratio_many(x, y), 0.95 * scale * _partial_token_ratio_many(x, y)])
    return out


RATIOS_MANY = {"ratio": ratio_many, "token_sort_ratio": token_sort_ratio_many, "token_set_ratio": token_set_ratio_many, "partial_ratio": partial_ratio_many, "weighted_ratio": weighted_ratio_many}


def best_of(*names: str):
    """UDF (a, b) -> double: the highest of the named ratios; null if either side is null. Equal pairs of a batch are compared once."""
    functions = [RATIOS_MANY[n] for n in names]

    @F.pandas_udf(DoubleType())
    def udf(a: pd.Series, b: pd.Series) -> pd.Series:
        pairs = list(zip(a, b, strict=True))
        own = [p for p in dict.fromkeys(pairs) if p[0] is not None and p[1] is not None]
        x, y = [p[0] for p in own], [p[1] for p in own]
        best = dict(zip(own, np.maximum.reduce([f(x, y) for f in functions]).tolist())) if own else {}
        return pd.Series([best.get(p) for p in pairs], dtype="float64")

    return udf


def ratio_column(a: Column, b: Column) -> Column:
    """ratio() without Python: rows of the subsequence table as arrays, each a running maximum."""
    y = F.split(b, "")
    start = F.array_repeat(F.lit(0), F.length(b) + 1)

    def row(above: Column, ch: Column) -> Column:
        grown = F.zip_with(y, F.sequence(F.lit(1), F.length(b)), lambda c, j: F.greatest(F.get(above, j), F.get(above, j - 1) + F.when(c == ch, 1).otherwise(0)))
        return F.aggregate(grown, F.array(F.lit(0)), lambda acc, v: F.concat(acc, F.array(F.greatest(F.element_at(acc, -1), v))))

    last = F.aggregate(F.split(a, ""), start, row)
    total = F.length(a) + F.length(b)
    return F.when(total == 0, F.lit(100.0)).when((F.length(a) == 0) | (F.length(b) == 0), F.lit(0.0)).otherwise(F.lit(200.0) * F.element_at(last, -1) / total)
