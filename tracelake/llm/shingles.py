"""Five-word shingles of whole texts as 64-bit hashes, vectorised over the UTF-8 bytes of a batch.

A-Z are lower-cased; words are runs of bytes other than ASCII white space.  A text with fewer than five words has its
whole word sequence as one shingle; one without words has none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

WORDS = 5
#: Bytes hashed at a time: small arrays stay in the processor's cache.
CHUNK = 1 << 19

_U = np.uint64
_ODD = _U(0x9E3779B97F4A7C15)
_byte_value = np.random.default_rng(20250101).integers(1, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)
_byte_value[65:91] = _byte_value[97:123]
_is_word = np.ones(256, bool)
_is_word[[32, 9, 10, 11, 12, 13]] = False
_BASE = _U(0xD6E8FEB86659FD93)
_INVERSE = _U(pow(int(_BASE), -1, 1 << 64))
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        m = max(n, CHUNK + 1)
        for i, base in enumerate((_BASE, _INVERSE)):
            p = np.full(m, base, np.uint64)
            p[0] = 1
            _powers[i] = np.multiply.accumulate(p)
    return _powers[0][:n], _powers[1][:n]


def hashed(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For texts laid end to end in data (text i ends at ends[i]): all shingle hashes in order, repeated ones too;
    the number of shingles of each text; its number of words."""
    n = len(data)
    if n == 0:
        zero = np.zeros(len(ends), np.int64)
        return np.zeros(0, np.uint64), zero, zero
    word = _is_word[data]
    first = np.empty(n, bool)
    first[0] = True
    first[1:] = ~word[:-1]
    cuts = ends[:-1]
    first[cuts[cuts < n]] = True
    first &= word
    starts = np.flatnonzero(first)
    last = np.empty(n, bool)
    last[-1] = True
    last[:-1] = ~word[1:]
    last[ends[ends > 0] - 1] = True
    last &= word
    stops = np.flatnonzero(last) + 1
    power, inverse = _power(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_byte_value[data] * power[:n], out=total[1:])
    w = mix((total[stops] - total[starts]) * inverse[starts] + (stops - starts).astype(np.uint64) * _ODD)
    n_words = np.diff(np.searchsorted(starts, ends, "left"), prepend=0)
    n_shingles = np.where(n_words >= WORDS, n_words - WORDS + 1, np.minimum(n_words, 1))
    begins = np.cumsum(n_words) - n_words
    s = w[: len(w) - WORDS + 1] * _U(3) if len(w) >= WORDS else np.zeros(0, np.uint64)
    for i in range(1, WORDS if len(s) else 0):
        s = mix(s) + w[i : len(w) - WORDS + 1 + i]
    s = mix(s)
    lead = np.cumsum(n_shingles) - n_shingles
    at = np.repeat(begins - lead, n_shingles) + np.arange(n_shingles.sum())
    out = np.empty(len(at), np.uint64)
    few = np.repeat(n_words < WORDS, n_shingles)
    out[~few] = s[at[~few]]
    for i in np.flatnonzero((n_words > 0) & (n_words < WORDS)):
        h = _U(n_words[i])[None]
        for x in w[begins[i] : begins[i] + n_words[i]]:
            h = mix(h + _ODD) + x
        out[lead[i]] = mix(h)[0]
    return out, n_shingles, n_words


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or large_string column, nulls as empty, and where each text ends."""
    column = column.fill_null("") if column.null_count else column
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    offsets = np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if not len(column) or column.buffers()[2] is None:
        return np.zeros(0, np.uint8), np.zeros(len(column), np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets[1:] - offsets[0]


def chunks(data: np.ndarray, ends: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(from, to, bytes, ends) over runs of whole texts of about CHUNK bytes; a longer text stands alone."""
    i, begun = 0, 0
    while i < len(ends):
        j = max(i + 1, int(np.searchsorted(ends, begun + CHUNK, "right")))
        yield i, j, data[begun : ends[j - 1]], ends[i:j] - begun
        i, begun = j, int(ends[j - 1])


def sets(data: np.ndarray, ends: np.ndarray) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    for _, _, part, stops in chunks(data, ends):
        h, n, _ = hashed(part, stops)
        at = 0
        for k in n:
            x = np.sort(h[at : at + k])
            at += k
            yield x[np.concatenate(([True], x[1:] != x[:-1]))] if k else x
