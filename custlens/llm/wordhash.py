"""Words and word shingles of an Arrow batch as numpy arrays, without a Python
object per word.  A word is a run of bytes other than space and U+0009-U+000D."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
#: Bytes hashed at a time.
_SEGMENT = 1 << 20
#: Words of a shingle.
SHINGLE = 5


def mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of SplitMix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts (null: none) and the offsets of each."""
    if texts.null_count:
        texts = texts.fill_null("")
    if pa.types.is_large_string(texts.type):
        texts = texts.cast(pa.string())
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int32)[texts.offset:texts.offset + len(texts) + 1].astype(np.int64) if offsets else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8)[offsets[0]:offsets[-1]] if data else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def find_words(data: np.ndarray, offsets: np.ndarray, between: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and for each text the first of its words:
    words first[i] to first[i + 1] belong to text i.  ``between``: for each byte
    value, whether it parts words."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    space = between[data]
    edge = np.empty(n + 1, bool)
    edge[0], edge[1:] = True, space
    edge[offsets] = True
    inside = ~space
    starts = np.flatnonzero(inside & edge[:-1])
    edge[0] = False
    edge[:-1] = space
    edge[-1] = True
    edge[offsets] = True
    ends = np.flatnonzero(inside & edge[1:]) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def hash_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0, lower: bool = True) -> np.ndarray:
    """64-bit hashes of data[starts[i]:ends[i]], A-Z as a-z; the spans do not overlap."""
    out = np.empty(len(starts), np.uint64)
    if not len(starts):
        return out
    longest = int((ends - starts).max())
    power = np.full(longest, _BASE + np.uint64(2 * seed), np.uint64)
    power[0] = 1
    power = np.multiply.accumulate(power)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(starts, starts[i] + _SEGMENT)))
        s, e = starts[i:j], ends[i:j]
        size = e - s
        begin = np.cumsum(size) - size
        within = np.arange(int(size.sum())) - np.repeat(begin, size)
        raw = data[np.repeat(s, size) + within]
        raw = (_LOWER[raw] if lower else raw).astype(np.uint64)
        raw += np.uint64(1)
        raw *= power[within]
        out[i:j] = mix(np.add.reduceat(raw, begin) + size.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        i = j
    return out


def hash_runs(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of each n words in a row; as many as words minus n - 1."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(words) - n + 1, np.uint64)
    for k in range(n):
        out = (out ^ words[k:len(words) - n + 1 + k]) * np.uint64(0xFF51AFD7ED558CCD)
        out ^= out >> np.uint64(32)
    return mix(out + np.uint64(n))


def shingle_sets(texts: pa.Array, n: int = SHINGLE) -> list[np.ndarray]:
    """Each text's sorted distinct shingle hashes: n words, A-Z lower-cased; all
    words as one where there are fewer; none without words."""
    data, offsets = text_bytes(texts)
    starts, ends, first = find_words(data, offsets)
    words = hash_words(data, starts, ends)
    runs = hash_runs(words, n)
    out = []
    for i, j in zip(first[:-1].tolist(), first[1:].tolist()):
        if j - i >= n:
            s = np.sort(runs[i:j - n + 1])
            out.append(s[np.concatenate([[True], s[1:] != s[:-1]])])
        else:
            out.append(hash_runs(words[i:j], j - i) if j > i else np.zeros(0, np.uint64))
    return out
