"""Weighted shingles of texts and their consistent weighted samples."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

from .units import Known

WORDS = 5
U64 = np.uint64
#: Odd multipliers of a 64-bit finaliser.
M1, M2, M3 = U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB), U64(0x9E3779B97F4A7C15)
CACHE_WORDS = 150_000
#: Shingles that a set and a block have in common, counted at a time.
MEETINGS = 1 << 18


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U64(30))) * M1
    x = (x ^ (x >> U64(27))) * M2
    return x ^ (x >> U64(31))


class WordHash:
    """64-bit hashes of words; a bounded number is kept."""

    def __init__(self):
        import xxhash

        self.hash, self.room = xxhash.xxh3_64_intdigest, CACHE_WORDS
        self.known = Known(self._new)

    def _new(self, word: str) -> int:
        h = self.hash(word.encode())
        if self.room > 0:
            self.known[word] = h
            self.room -= 1
        return h

    def shingles(self, text: str) -> np.ndarray:
        """32-bit hashes of all runs of WORDS words, in order; a shorter text is one run; no words, none."""
        words = text.split()
        n = len(words)
        if not n:
            return np.empty(0, np.uint32)
        h = np.fromiter(map(self.known.__getitem__, words), U64, n)
        k = min(WORDS, n)
        out = np.zeros(n - k + 1, U64)
        for i in range(k):
            out = mix(out * M3 + h[i : n - k + 1 + i])
        return (out >> U64(32)).astype(np.uint32)


def counted(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes in order, and how often each stands in the text."""
    h = np.sort(hashes)
    at = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.empty(0, np.int64)
    return h[at], np.diff(np.append(at, len(h))).astype(np.float32)


def packed(h: np.ndarray, tf: np.ndarray) -> tuple[bytes, bytes]:
    """A set as bytes: its hashes, and (place, count) of those that stand more than once."""
    many = np.flatnonzero(tf != 1)
    return h.astype("<u4").tobytes(), np.stack([many, tf[many]], 1).astype("<u4").tobytes()


def unpacked(h: bytes, many: bytes) -> tuple[np.ndarray, np.ndarray]:
    out = np.frombuffer(h, "<u4")
    tf = np.ones(len(out), np.float32)
    if many:
        at = np.frombuffer(many, "<u4").reshape(-1, 2)
        tf[at[:, 0]] = at[:, 1]
    return out, tf


class Idf:
    """Smoothed logarithmic inverse document frequency: (1 + log(1 / p) / log(1 / rare)) / 2, p being rare at least.

    So it falls from 1, for shingles in up to `rare` of all documents, to 1/2 for one that
    stands in all of them. Only the shingles over `rare` need a table, and its size does not
    grow with the documents. The 1 is the smoothing: without it the one-off shingles of an
    edit would outweigh all the text that a large group of copies shares.
    """

    def __init__(self, hashes: np.ndarray, parts: np.ndarray, rare: float):
        order = np.argsort(hashes)
        self.h = hashes[order].astype(np.uint32)
        self.w = ((1 + np.log(np.clip(parts[order], rare, 1.0)) / np.log(rare)) / 2).astype(np.float32)
        #: One bit for each hash value modulo 2^16: most shingles are told apart by it.
        self.maybe = np.zeros(1 << 16, bool)
        self.maybe[self.h & 0xFFFF] = True

    def weights(self, h: np.ndarray, tf: np.ndarray) -> np.ndarray:
        out = tf.copy()
        if len(self.h):
            at = np.flatnonzero(self.maybe[h & 0xFFFF])
            pos = np.minimum(np.searchsorted(self.h, h[at]), len(self.h) - 1)
            hit = self.h[pos] == h[at]
            out[at[hit]] *= self.w[pos[hit]]
        return out


def _gamma2(cells: int) -> np.ndarray:
    """Quantiles of Gamma(2, 1) at the middles of equal cells: x with 1 - (1 + x) e^-x = u."""
    u = (np.arange(cells) + 0.5) / cells
    x = np.where(u < 0.5, np.sqrt(2 * u), -np.log1p(-u) + np.log1p(-np.log1p(-u)))
    for _ in range(60):
        x = np.maximum(1e-12, x - (1 - (1 + x) * np.exp(-x) - u) / (x * np.exp(-x)))
    return x


@lru_cache(maxsize=1)
def tables() -> tuple[np.ndarray, np.ndarray]:
    """Values of r (2^12 cells) and log c (2^16 cells) by hash bits."""
    return _gamma2(1 << 12).astype(np.float32), np.log(_gamma2(1 << 16)).astype(np.float32)


class ConsistentSampler:
    """Improved consistent weighted sampling: each of k samples picks (shingle, level) of a weighted set.

    Two sets pick the same with probability equal to their weighted Jaccard similarity.
    For a shingle of weight w, with r, c ~ Gamma(2, 1) and b ~ U(0, 1) drawn from its hash:
    t = floor(ln w / r + b), ln a = ln c - r (t - b + 1); the least ln a is picked.
    """

    def __init__(self, bands: int, rows: int):
        self.bands, self.rows = bands, rows
        self.seeds = mix(np.arange(1, bands * rows + 1, dtype=U64) * M3)

    def band_hashes(self, h: np.ndarray, w: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """(sets, bands) hashes; set i has elements starts[i] up to starts[i + 1] (none is empty)."""
        r_of, c_of = tables()
        n, h = len(starts), h.astype(U64)
        segment = np.repeat(np.arange(n), np.diff(np.append(starts, len(h))))
        odd = np.flatnonzero(w != 1)
        lnw = np.log(w[odd])
        out = np.zeros((n, self.bands), U64)
        picked, level = np.empty(n, np.int64), np.zeros(len(h), np.int64)
        for k, seed in enumerate(self.seeds):
            z = (h ^ seed) * M1
            z ^= z >> U64(32)
            z *= M2
            z ^= z >> U64(29)
            b = (z >> U64(40)).astype(np.float32) * np.float32(2.0**-24)
            r = r_of[((z >> U64(28)) & U64(0xFFF)).view(np.int64)]
            lna = c_of[((z >> U64(12)) & U64(0xFFFF)).view(np.int64)]
            lna -= r * (1 - b)
            if len(odd):
                t = np.floor(lnw / r[odd] + b[odd])
                lna[odd] -= r[odd] * t
                level[odd] = t
            least = np.minimum.reduceat(lna, starts)
            at = np.flatnonzero(lna == least[segment])[::-1]
            picked[segment[at]] = at
            sample = mix(h[picked] + level[picked].astype(U64) * M3)
            j = k // self.rows
            out[:, j] = mix(out[:, j] * M3 + sample + U64(j + 1))
        return out


Weighted = tuple[np.ndarray, np.ndarray]


def weighted_jaccard(a: Weighted, b: Weighted) -> float:
    """Of two sets of (distinct hashes in order, weights)."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    low = float(np.minimum(a[1][i], b[1][j]).astype(np.float64).sum())
    total = float(a[1].astype(np.float64).sum() + b[1].astype(np.float64).sum())
    return low / (total - low) if total > low else 1.0


class Block:
    """Weighted sets whose similarities to another set are found all at once."""

    def __init__(self, sets: list[tuple[np.ndarray, np.ndarray]]):
        h = np.concatenate([x for x, _ in sets])
        order = np.argsort(h, kind="stable")
        self.h, self.n = h[order], len(sets)
        self.owner = np.repeat(np.arange(self.n, dtype=np.int32), [len(x) for x, _ in sets])[order]
        self.w = np.concatenate([w for _, w in sets])[order]
        self.total = np.bincount(self.owner, self.w, minlength=self.n)

    def similarities(self, h: np.ndarray, w: np.ndarray) -> np.ndarray:
        """weighted_jaccard() of (h, w) with every set of the block. Common shingles are met MEETINGS at a time: long near copies share millions."""
        lo, hi = np.searchsorted(self.h, h, "left"), np.searchsorted(self.h, h, "right")
        times = hi - lo
        ends, low, first = np.cumsum(times), np.zeros(self.n), 0
        while first < len(h):
            before = ends[first] - times[first]
            last = max(first + 1, int(np.searchsorted(ends, before + MEETINGS, "right")))
            some = times[first:last]
            at = np.repeat(lo[first:last] - ends[first:last] + some + before, some) + np.arange(some.sum())
            low += np.bincount(self.owner[at], np.minimum(self.w[at], np.repeat(w[first:last], some)), minlength=self.n)
            first = last
        both = self.total + float(w.astype(np.float64).sum())
        return np.divide(low, both - low, out=np.ones(self.n), where=both > low)
