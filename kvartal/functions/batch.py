"""Jaro-Winkler of whole Arrow batches: the same values as similarity.py, for joins with many pairs.

The letters of all pairs of a batch are compared together, one position of the first strings at a time.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def encode(texts: list[str], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Code points in rows of the given width, and lengths."""
    out, long = np.zeros((len(texts), width), np.int32), np.array([len(t) for t in texts], np.int64)
    out[np.arange(width) < long[:, None]] = np.frombuffer("".join(texts).encode("utf-32-le"), np.int32)
    return out, long


def _wide_jaro(a: list[str], b: list[str]) -> np.ndarray:
    """jaro for strings or alphabets that no word of 64 bits holds."""
    n = len(a)
    if not n:
        return np.zeros(0)
    wa, wb = max(map(len, a)), max(map(len, b))
    x, la = encode(a, wa)
    y, lb = encode(b, wb)
    window = np.maximum(0, np.maximum(la, lb) // 2 - 1)
    at = np.arange(wb)
    free = at < lb[:, None]
    met = np.zeros((n, wa), bool)
    for i in range(wa):
        near = free & (y == x[:, i : i + 1]) & (np.abs(at - i) <= window[:, None]) & (i < la)[:, None]
        rows = np.flatnonzero(near.any(1))
        free[rows, near[rows].argmax(1)] = False
        met[rows, i] = True
    taken = ~free & (at < lb[:, None])
    m = met.sum(1)
    most = int(m.max())
    # Matched letters of both sides in their order, side by side.
    u = np.take_along_axis(x, np.argsort(~met, axis=1, kind="stable")[:, :most], 1)
    v = np.take_along_axis(y, np.argsort(~taken, axis=1, kind="stable")[:, :most], 1)
    moved = ((u != v) & (np.arange(most) < m[:, None])).sum(1)
    with np.errstate(divide="ignore", invalid="ignore"):
        out = (m / la + m / lb + (m - moved / 2.0) / m) / 3.0
    return np.where(m == 0, 0.0, out)


#: Letters of a string at most, pairs at once, and letters in the alphabet of these at most, for jaro by bits.
BITS, CHUNK, ALPHABET = 64, 1 << 16, 256


def _jaro_of(words: list[str], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Jaro similarities of the non-empty words numbered i and j. Which letters of the second word are still free, and where it
    has the letter at hand, are bits of one number."""
    n = len(i)
    if not n:
        return np.zeros(0)
    width = max(map(len, words))
    codes, long = encode(words, min(width, BITS) if width <= BITS else width)
    present = np.zeros(int(codes.max()) + 1, bool)
    present[codes] = True
    letters = int(present.sum())
    if width > BITS or letters > ALPHABET:
        return _wide_jaro([words[k] for k in i], [words[k] for k in j])
    codes = (np.cumsum(present) - 1).astype(np.uint8)[codes]
    one, none = np.uint64(1), np.uint64(0)
    where = np.zeros((len(words), letters), np.uint64)  # the places of each letter in each word
    for k in range(width):
        rows = np.flatnonzero(long > k)
        where[rows, codes[rows, k]] |= one << np.uint64(k)
    full = np.where(long >= 64, ~none, (one << np.minimum(long, 63).astype(np.uint64)) - one)
    la, lb = long[i], long[j]
    window = np.maximum(0, np.maximum(la, lb) // 2 - 1)
    free, met = full[j], np.zeros(n, np.uint64)
    below = lambda k: np.where(k >= 64, ~none, (one << np.clip(k, 0, 63).astype(np.uint64)) - one)
    for k in range(int(la.max())):
        near = where[j, codes[i, k]] & free & below(k + window + 1) & ~below(k - window)
        near[k >= la] = none
        first = near & (~near + one)
        free ^= first
        met |= np.where(first != none, one << np.uint64(k), none)
    taken = full[j] & ~free
    m = np.bitwise_count(met).astype(np.int64)
    moved, s, t = np.zeros(n, np.int64), met.copy(), taken
    for k in range(int(m.max())):
        x, y = s & (~s + one), t & (~t + one)
        u, v = np.bitwise_count(x - one) & 63, np.bitwise_count(y - one) & 63
        moved += (codes[i, np.minimum(u, width - 1)] != codes[j, np.minimum(v, width - 1)]) & (k < m)
        s, t = s ^ x, t ^ y
    with np.errstate(divide="ignore", invalid="ignore"):
        out = (m / la + m / lb + (m - moved / 2.0) / m) / 3.0
    return np.where(m == 0, 0.0, out)


def _numbered(a: list[str], b: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The distinct texts, and the numbers of a and of b among them."""
    codes, words = pd.factorize(np.array([*a, *b], object))
    return list(words), codes[: len(a)], codes[len(a) :]


def _by_chunks(words: list[str], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """_jaro_of over parts of the pairs, each with its own words and alphabet."""
    out = np.zeros(len(i))
    for at in range(0, len(i), CHUNK):
        near = np.r_[i[at : at + CHUNK], j[at : at + CHUNK]]
        used, own = np.unique(near, return_inverse=True)
        half = len(near) // 2
        out[at : at + CHUNK] = _jaro_of([words[k] for k in used], own[:half], own[half:])
    return out


def jaro(a: list[str], b: list[str]) -> np.ndarray:
    """Jaro similarities of pairs of non-empty strings."""
    return _by_chunks(*_numbered(a, b)) if len(a) else np.zeros(0)


def _winkler(words: list[str], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """jaro_winkler of the words numbered i and j."""
    low, small = pd.factorize(np.array([s.lower() for s in words], object))
    small = list(small)
    i, j = low[i], low[j]
    empty = np.array([not s for s in small], bool)
    out = np.where((i == j) & ~empty[i], 1.0, 0.0)
    open_ = np.flatnonzero((i != j) & ~empty[i] & ~empty[j])
    if len(open_):
        i, j = i[open_], j[open_]
        score = _by_chunks(small, i, j)
        heads, long = encode([s[:4] for s in small], 4)
        same = (heads[i] == heads[j]) & (np.arange(4) < np.minimum(long[i], long[j])[:, None])
        prefix = np.logical_and.accumulate(same, axis=1).sum(1)
        out[open_] = np.where(score < 0.7, score, score + prefix * 0.1 * (1.0 - score))
    return out


def jaro_winkler(a: list[str], b: list[str]) -> np.ndarray:
    """0 where a string is empty, 1 where they are equal but for case; the prefix counts from a Jaro of 0.7."""
    return _winkler(*_numbered(a, b)) if len(a) else np.zeros(0)


def sorted_tokens(text: str) -> str:
    return " ".join(sorted(w for w in text.lower().split() if len(w) > 1))


def token_similarity(a: list[str], b: list[str]) -> np.ndarray:
    if not len(a):
        return np.zeros(0)
    words, i, j = _numbered(a, b)
    keys = [sorted_tokens(t) for t in words]
    whole = np.array([bool(k) for k in keys])
    both = whole[i] & whole[j]
    n = len(words)
    return _winkler([*words, *keys], np.where(both, i + n, i), np.where(both, j + n, j))


class Words:
    """Similarities of numbered words, each encoded once: the same values as token_similarity."""

    def __init__(self, words: list[str]):
        keys = [sorted_tokens(w) for w in words]
        codes, texts = pd.factorize(np.array([*(w.lower() for w in words), *keys, ""], object))
        self.texts = list(texts)
        self.raw, self.key = codes[: len(words)], codes[len(words) : 2 * len(words)]
        self.whole, self.empty = np.array([bool(k) for k in keys], bool), codes[-1]
        self.heads, _ = encode([s[:4] for s in self.texts], 4)
        self.long = np.array([len(s) for s in self.texts], np.int64)
        self.wide = self.long > BITS
        kept = ["" if w else s for s, w in zip(self.texts, self.wide)]
        width = max(1, max(map(len, kept)))
        letters, _ = encode(kept, width)
        present, codes = np.unique(letters, return_inverse=True)
        if len(present) > ALPHABET:
            self.wide[:] = True
            return
        self.codes = codes.reshape(letters.shape).astype(np.uint8)
        one, none = np.uint64(1), np.uint64(0)
        self.where = np.zeros((len(kept), len(present)), np.uint64)
        for k in range(width):
            rows = np.flatnonzero((self.long > k) & ~self.wide)
            self.where[rows, self.codes[rows, k]] |= one << np.uint64(k)
        self.full = np.where(self.long >= 64, ~none, (one << np.minimum(self.long, 63).astype(np.uint64)) - one)
        # Which letters a word has, and which at least twice; letters that share a bit only hide a difference.
        self.bag = np.zeros(len(kept), np.uint64)
        for c in range(len(present)):
            times = np.bitwise_count(self.where[:, c])
            self.bag |= np.where(times > 0, one << np.uint64(c % 32), none) | np.where(times > 1, one << np.uint64(32 + c % 32), none)

    def similarity(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """token_similarity of the words numbered i and j."""
        both = self.whole[i] & self.whole[j]
        return self._winkler(np.where(both, self.key[i], self.raw[i]), np.where(both, self.key[j], self.raw[j]))

    def _winkler(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        out = np.where((x == y) & (x != self.empty), 1.0, 0.0)
        open_ = np.flatnonzero((x != y) & (x != self.empty) & (y != self.empty))
        wide = self.wide[x[open_]] | self.wide[y[open_]]
        if wide.any():
            far = open_[wide]
            out[far] = jaro_winkler([self.texts[k] for k in x[far]], [self.texts[k] for k in y[far]])
            open_ = open_[~wide]
        for at in range(0, len(open_), CHUNK):
            part = open_[at : at + CHUNK]
            part = part[np.argsort(-self.long[x[part]], kind="stable")]
            i, j = x[part], y[part]
            score = self._jaro(i, j)
            same = (self.heads[i] == self.heads[j]) & (np.arange(4) < np.minimum(self.long[i], self.long[j])[:, None])
            out[part] = np.where(score < 0.7, score, score + np.logical_and.accumulate(same, axis=1).sum(1) * 0.1 * (1.0 - score))
        return out

    def _jaro(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """As _jaro_of; the first texts stand by falling length."""
        one, none = np.uint64(1), np.uint64(0)
        la, lb = self.long[i], self.long[j]
        window = np.maximum(0, np.maximum(la, lb) // 2 - 1)
        spread = np.arange(int(window.max()) + 1)
        below = lambda k: np.where(k >= 64, ~none, (one << np.clip(k, 0, 63).astype(np.uint64)) - one)
        free, met = self.full[j], np.zeros(len(i), np.uint64)
        x = self.codes[i]
        for k in range(int(la[0])):
            n = np.searchsorted(-la, -k)  # of the texts longer than k
            near = self.where[j[:n], x[:n, k]] & free[:n] & (below(k + spread + 1) & ~below(k - spread))[window[:n]]
            first = near & (~near + one)
            free[:n] ^= first
            met[:n] |= (first != none).astype(np.uint64) << np.uint64(k)
        taken = self.full[j] & ~free
        m = np.bitwise_count(met).astype(np.int64)
        moved, s, t, last = np.zeros(len(i), np.int64), met.copy(), taken, self.codes.shape[1] - 1
        y = self.codes[j]
        rows = np.arange(len(i))
        for k in range(int(m.max())):
            u, v = s & (~s + one), t & (~t + one)
            a, b = np.bitwise_count(u - one), np.bitwise_count(v - one)
            moved += (x[rows, np.minimum(a, last)] != y[rows, np.minimum(b, last)]) & (k < m)
            s, t = s ^ u, t ^ v
        with np.errstate(divide="ignore", invalid="ignore"):
            out = (m / la + m / lb + (m - moved / 2.0) / m) / 3.0
        return np.where(m == 0, 0.0, out)

    def near(self, a: np.ndarray, b: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
        """Places in a and in b of all pairs of words that are similar enough. A pair is judged if its letters allow it:
        see linkage._alike."""
        a_at, b_at = np.flatnonzero(self.raw[a] != self.empty), np.flatnonzero(self.raw[b] != self.empty)
        loose = [self.whole[a[a_at]] & ~self.wide[self.key[a[a_at]]], self.whole[b[b_at]] & ~self.wide[self.key[b[b_at]]]]
        i, j = a_at[loose[0]], b_at[loose[1]]
        cross = lambda u, v: (np.repeat(u, len(v)), np.tile(v, len(u)))
        found: list[tuple[np.ndarray, np.ndarray]] = []

        def judge(u: np.ndarray, v: np.ndarray) -> None:
            for at in range(0, len(u), 1 << 18):
                p, q = u[at : at + (1 << 18)], v[at : at + (1 << 18)]
                ok = self.similarity(a[p], b[q]) >= least
                found.append((p[ok], q[ok]))

        judge(*cross(a_at[~loose[0]], b_at))
        judge(*cross(i, b_at[~loose[1]]))
        x, y = self.key[a[i]], self.key[b[j]]
        if len(x) and len(y):
            n, k, head, bag = self.long[y].astype(np.float32), self.long[x].astype(np.float32), self.heads[y, 0], self.bag[y]
            strict, mild = (np.float32(3 * (least - p / 10) / (1 - p / 10) - 1 - 1e-4) for p in (0, 4))
            step = max(1, (1 << 19) // len(y))
            us, vs, held = [], [], 0
            for at in range(0, len(x), step):
                own = self.bag[x[at : at + step], None]
                long = k[at : at + step, None]
                m = np.minimum(long - np.bitwise_count(own & ~bag), n - np.bitwise_count(bag & ~own))
                u, v = np.nonzero(m * (1 / long + 1 / n) >= np.where(self.heads[x[at : at + step], 0][:, None] == head, mild, strict))
                us.append(i[at + u])
                vs.append(j[v])
                held += len(u)
                if held >= 1 << 18:  # what the letters allow is judged before more of it is held
                    judge(np.concatenate(us), np.concatenate(vs))
                    us, vs, held = [], [], 0
            if held:
                judge(np.concatenate(us), np.concatenate(vs))
        return tuple(np.concatenate(z) for z in zip(*found)) if found else (np.zeros(0, np.int64),) * 2


def token_similarity_column(a: str, b: str) -> Column:
    """Column of token_similarity. Marked as not repeatable, so that a filter on it doesn't compute it twice."""

    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series(token_similarity(x.fillna("").tolist(), y.fillna("").tolist()))

    return F.pandas_udf(run, T.DoubleType()).asNondeterministic()(a, b)
