"""Two-stage suffix sorting, vectorised.

Stage one sorts only the suffixes smaller than their successors (type S), by their first `depth`
bytes. Stage two induces the rest (type L) by scanning the buckets of first bytes upwards: the
suffix before a scanned one, if of type L, goes to the next free place at the front of its own
bucket. A bucket is scanned in whole batches; runs of its own byte take one more batch a repeat.
The order is right to `depth` bytes, ties beyond it are left as they come.
"""

from __future__ import annotations

import numpy as np


def words_at(text: np.ndarray) -> np.ndarray:
    """The big-endian 8-byte word that starts at each byte; past the end stand 255s."""
    padded = np.concatenate([text, np.full(8, 255, np.uint8)]).astype(np.uint64)
    out = np.zeros(len(text), np.uint64)
    for k in range(8):
        out = (out << np.uint64(8)) | padded[k : k + len(text)]
    return out


def smaller_than_next(text: np.ndarray) -> np.ndarray:
    """Type S: the first byte that differs later is larger. The last suffix is of type L."""
    n = len(text)
    ends = np.append(np.flatnonzero(text[1:] != text[:-1]), n - 1)
    rises = np.append(text[ends[:-1]] < text[ends[:-1] + 1], False)
    return np.repeat(rises, np.diff(np.concatenate([[-1], ends])))


def sorted_directly(at: np.ndarray, words: np.ndarray, depth: int) -> np.ndarray:
    """Suffix starts in order of their first depth bytes, eight at a time, ties only."""
    last = len(words) - 1
    key = words[at]
    order = np.argsort(key, kind="stable")
    at, key = at[order], key[order]
    group = np.cumsum(np.concatenate([[0], key[1:] != key[:-1]]))
    for d in range(8, depth, 8):
        same = group[1:] == group[:-1]
        tied = np.flatnonzero(np.concatenate([[False], same]) | np.concatenate([same, [False]]))
        if not len(tied):
            break
        g, k = group[tied], words[np.minimum(at[tied] + d, last)]
        order = np.lexsort((k, g))
        at[tied] = at[tied[order]]
        k, g = k[order], g[order]
        new = np.concatenate([[True], (k[1:] != k[:-1]) | (g[1:] != g[:-1])])
        group[tied] = tied[np.maximum.accumulate(np.where(new, np.arange(len(tied)), 0))]
        if d == 8:  # group numbers so far count groups; from here on they are places
            rest = np.ones(len(at), bool)
            rest[tied] = False
            group[rest] = np.flatnonzero(rest)
    return at


def suffix_array(text: np.ndarray, depth: int = 104) -> np.ndarray:
    """Starts of all suffixes of a uint8 text in order of their first depth bytes."""
    n = len(text)
    if n < 2:
        return np.arange(n)
    small = smaller_than_next(text)
    direct = sorted_directly(np.flatnonzero(small), words_at(text), depth) if small.any() else np.zeros(0, np.int64)
    first = text[direct]
    bounds = np.searchsorted(first, np.arange(257))
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    waiting[text[n - 1]].append(np.array([n - 1]))

    def before(scanned: np.ndarray, c: int) -> np.ndarray:
        """Deals out the type L suffixes before the scanned ones; gives those of bucket c itself."""
        p = scanned[scanned > 0] - 1
        p = p[~small[p]]
        chars = text[p]
        own = p[chars == c]
        p, chars = p[chars != c], chars[chars != c]
        if len(p):
            order = np.argsort(chars, kind="stable")
            p, chars = p[order], chars[order]
            cuts = np.flatnonzero(np.concatenate([[True], chars[1:] != chars[:-1], [True]]))
            for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                waiting[chars[i]].append(p[i:j])
        return own

    out = []
    for c in range(256):
        batch = np.concatenate(waiting[c]) if waiting[c] else np.zeros(0, np.int64)
        waiting[c] = []
        while len(batch):
            out.append(batch)
            batch = before(batch, c)
        batch = direct[bounds[c] : bounds[c + 1]]
        if len(batch):
            out.append(batch)
            before(batch, c)
    return np.concatenate(out)


def common_prefix_at_least(at: np.ndarray, words: np.ndarray, length: int) -> np.ndarray:
    """For neighbours at[i-1], at[i]: whether their first length bytes agree (first entry False)."""
    same = np.zeros(len(at), bool)
    alive = np.arange(1, len(at))
    steps = [*range(0, length - 7, 8), *([length - 8] if length % 8 else [])]
    for d in steps:
        alive = alive[words[at[alive] + d] == words[at[alive - 1] + d]]
    same[alive] = True
    return same
