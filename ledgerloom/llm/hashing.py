"""Vectorised hashing of words and shingles of many texts at once."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of splitmix: a bijection."""
    x = np.asarray(x, np.uint64) + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
LONG = np.uint64(1 << 41)
with np.errstate(over="ignore"):
    PLACE = mix(np.arange(1 << 16, dtype=np.uint64)) | np.uint64(1)
    STEP = mix(np.arange(64, dtype=np.uint64) + np.uint64(1 << 40)) | np.uint64(1)


def slices(texts: pa.Array, most_bytes: int = 2_000_000):
    """(lo, hi) of runs of texts of about ``most_bytes`` together; a longer text stands alone."""
    lengths = pc.binary_length(texts.cast(pa.large_string())).fill_null(0).to_numpy(zero_copy_only=False)
    lo, total = 0, 0
    for i, n in enumerate(lengths):
        if i > lo and total + n > most_bytes:
            yield lo, i
            lo, total = i, 0
        total += n
    if lo < len(lengths):
        yield lo, len(lengths)


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words (runs of other bytes than space and tab to return, A-Z lower-cased)
    back to back, and the number of words of each text."""
    data = LOWER[np.frombuffer(b"\n".join([*texts, b""]), np.uint8)]
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(texts), np.int64)
    inside = ~WHITE[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    starts = np.flatnonzero(first)
    ends = np.cumsum([len(t) + 1 for t in texts])
    count = np.diff(np.concatenate(([0], np.searchsorted(starts, ends))))
    if not len(starts):
        return np.zeros(0, np.uint64), count
    at = np.flatnonzero(inside)
    word = np.cumsum(first)[at] - 1
    place = at - starts[word]
    with np.errstate(over="ignore"):
        factor = PLACE[place & 0xFFFF]
        long = np.flatnonzero(place > 0xFFFF)  # each 64 Ki of a long word have factors of their own
        if len(long):
            factor[long] = mix(place[long].astype(np.uint64) ^ LONG) | np.uint64(1)
        part = (data[at].astype(np.uint64) + np.uint64(1)) * factor
        cuts = np.searchsorted(at, starts)
        sums = np.add.reduceat(part, cuts)
        length = np.diff(np.concatenate((cuts, [len(at)]))).astype(np.uint64)
        return mix(sums ^ mix(length)), count


def shingle_sets(texts: list[bytes], k: int) -> list[np.ndarray]:
    """The distinct k-word shingles of each text as sorted 64-bit hashes; fewer words are one."""
    words, count = word_hashes(texts)
    ends = np.cumsum(count)
    out = []
    with np.errstate(over="ignore"):
        n = max(0, len(words) - k + 1)
        grams = np.zeros(n, np.uint64)
        for j in range(k):
            grams += words[j : j + n] * STEP[j]
        grams = mix(grams)
        for lo, hi in zip(ends - count, ends, strict=True):
            if hi - lo >= k:
                out.append(np.unique(grams[lo : hi - k + 1]))
            elif hi > lo:
                out.append(mix(np.array([(words[lo:hi] * STEP[: hi - lo]).sum() ^ STEP[-(hi - lo)]], np.uint64)))
            else:
                out.append(np.zeros(0, np.uint64))
    return out
