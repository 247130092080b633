"""Hashes of the words, shingles and byte n-grams of many texts at once, from the Arrow buffers that hold them.

Words are runs of bytes other than space and \\t to \\r. Nothing here loops over words or characters in Python.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
_BASE, _INVERSE = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)
_PLACE = np.array([pow(0xD6E8FEB86659FD93, i + 1, 1 << 64) for i in range(16)], U)
_powers = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads each bit over all."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def powers(base: int, n: int) -> np.ndarray:
    if len(_powers.get(base, ())) < n:
        _powers[base] = np.cumprod(np.concatenate((np.ones(1, U), np.full(max(n, 1 << 16) - 1, base, U))), dtype=U)
    return _powers[base][:n]


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of the texts one after the other, and where each starts and the last ends. Nulls are empty."""
    texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and len(texts) else np.zeros(0, np.uint8)
    return raw, at - at[0]


def portions(texts: pa.Array, size: int = 1 << 20) -> Iterator[pa.Array]:
    """The texts in turn, so many together as have about size bytes."""
    _, at = buffers(texts)
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(at, at[i] + size, "right")) - 1)
        yield texts.slice(i, j - i)
        i = j


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each word, and the number of words of each text."""
    raw, at = buffers(texts)
    if not len(raw):
        return np.zeros(0, U), np.zeros(len(texts), np.int64)
    solid = ~((raw == 32) | ((raw >= 9) & (raw <= 13)))
    first = np.zeros(len(raw) + 1, bool)
    first[at] = True
    starts = np.flatnonzero(solid & (first[:-1] | np.concatenate(([True], ~solid[:-1]))))
    ends = np.flatnonzero(solid & (first[1:] | np.concatenate((~solid[1:], [True])))) + 1
    total = np.concatenate((np.zeros(1, U), np.cumsum((raw + np.uint16(1)).astype(U) * powers(_BASE, len(raw)), dtype=U)))
    hashes = mix((total[ends] - total[starts]) * powers(_INVERSE, len(raw))[starts])
    return hashes, np.diff(np.searchsorted(starts, at))


def shingle_hashes(texts: pa.Array, n: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each n words in a row (of all words of a text with fewer), and the number of these of each text."""
    words, count = word_hashes(texts)
    return _shingles(words, count, np.where(count >= n, count - n + 1, np.minimum(count, 1)), n)


def word_grams(texts: pa.Array, orders: tuple[int, ...], bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each order n, the bucket, of 2 ** bits, of each n words in a row, and the number of these of each text. Texts
    with fewer words have none; the hash of n words differs with n."""
    words, count = word_hashes(texts)
    for n in orders:
        h, out = _shingles(words, count, np.maximum(count - n + 1, 0), n)
        yield (h >> U(64 - bits)).astype(np.int64), out


def _shingles(words: np.ndarray, count: np.ndarray, out: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """A hash of the n words, or as many as there are, from each of a text's first `out` words on."""
    start = np.cumsum(count) - count
    here = np.repeat(start - (np.cumsum(out) - out), out) + np.arange(out.sum())
    length = np.repeat(np.minimum(count, n), out)
    x = length.astype(U)
    for i in range(n):
        has = i < length
        x += np.where(has, words[np.where(has, here + i, 0)] if len(words) else U(0), U(0)) * _PLACE[i]
    return mix(x), out


def byte_grams(texts: pa.Array, n: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The bucket, of 2 ** bits, of each n bytes in a row, and the number of these of each text. n: 8 at most."""
    raw, at = buffers(texts)
    out = np.maximum(np.diff(at) - n + 1, 0)
    here = np.repeat(at[:-1] - (np.cumsum(out) - out), out) + np.arange(out.sum())
    wide = np.zeros(max(len(raw) - n + 1, 0), U)
    for i in range(n if len(wide) else 0):
        wide |= raw[i : len(raw) - n + 1 + i].astype(U) << U(8 * i)
    return ((wide[here] * U(_BASE)) >> U(64 - bits)).astype(np.int64), out
