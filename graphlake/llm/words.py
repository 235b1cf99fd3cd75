"""Words of many texts at once, hashed from their bytes without making a string of each.

The hash of a word is a polynomial over its bytes, taken as a difference of prefix sums over powers
of an odd base, then mixed to 64 bits.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa

ODD = np.uint64(0x9E3779B97F4A7C15)
BASE, STEP = 0xD6E8FEB86659FD93, 1 << 20
#: ASCII white space.
SPACE = np.zeros(256, bool)
SPACE[list(b" \t\n\x0b\x0c\r")] = True


@cache
def powers() -> tuple[np.ndarray, np.ndarray]:
    """Of BASE and of its inverse modulo 2^64."""
    return tuple(np.concatenate([[np.uint64(1)], np.cumprod(np.full(STEP, np.uint64(x)))]) for x in (BASE, pow(BASE, -1, 2**64)))


def byte_words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, hash) of each word of a byte array; words are runs of anything but ASCII white space."""
    power, inverse = powers()
    edges = np.flatnonzero(np.diff(np.concatenate([[True], SPACE[data], [True]])))
    start, stop = edges[::2], edges[1::2]
    out = np.empty(len(start), np.uint64)
    lo = first = 0
    while first < len(start):  # whole words, about STEP bytes at a time; a longer word by itself, in parts
        lo = int(start[first])
        last = max(first + 1, int(np.searchsorted(stop, lo + STEP, "right")))
        end = int(stop[last - 1])
        if end - lo <= STEP:
            sums = np.concatenate([[np.uint64(0)], np.cumsum((data[lo:end] + np.uint64(1)) * power[: end - lo])])
            a, b = start[first:last] - lo, stop[first:last] - lo
            out[first:last] = (sums[b] - sums[a]) * inverse[a]
        else:
            total, shift = np.uint64(0), np.uint64(1)
            for at in range(lo, end, STEP):
                part = data[at : min(at + STEP, end)]
                total += ((part + np.uint64(1)) * power[: len(part)]).sum(dtype=np.uint64) * shift
                shift *= power[STEP]
            out[first] = total
        first = last
    return start, mixed(out + (stop - start).astype(np.uint64) * ODD)


def joined(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all texts, a line break between them; where each text ends there)."""
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    return np.frombuffer(b"\n".join(raw), np.uint8), np.cumsum([len(r) + 1 for r in raw]) - 1


def word_hashes(texts: list[str] | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hash of each word, words of each text)."""
    data, ends = joined(texts if isinstance(texts, list) else texts.to_pylist())
    start, own = byte_words(data)
    return own, np.diff(np.searchsorted(start, ends), prepend=0)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: list[str] | pa.Array, size: int = 5) -> list[np.ndarray]:
    """The distinct shingles of `size` words of each text, as sorted hashes.

    A text of fewer words has one shingle of all its words, a text without words none.
    """
    h, counts = word_hashes(texts)
    ends = np.cumsum(counts)
    rolled = np.zeros(max(0, len(h) - size + 1), np.uint64)
    for j in range(size):
        rolled = rolled * ODD + h[j : len(h) - size + 1 + j]
    rolled = mixed(rolled)
    out = []
    for n, end in zip(counts.tolist(), ends.tolist(), strict=True):
        if n >= size:
            s = np.sort(rolled[end - n : end - size + 1])
            out.append(s[np.concatenate([[True], s[1:] != s[:-1]])])
        elif n:
            one = np.array([n], np.uint64)
            for x in h[end - n : end]:
                one = one * ODD + x
            out.append(mixed(one))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
