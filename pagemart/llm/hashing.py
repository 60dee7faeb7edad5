"""Hashes of all words of a batch of texts, by array operations on its bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Hashed in place of the end of a text; no word can be it but by a hash collision.
END = np.uint64(0x9E3779B97F4A7C15)

_SEED = np.random.Generator(np.random.PCG64(20240601))
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
#: A random number per byte, the same for a letter A-Z and its small form; none for spaces.
_BYTE = _SEED.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_EXACT_BYTE = _BYTE.copy()
_BYTE[65:91] = _BYTE[97:123]
_BYTE[_SPACE] = _EXACT_BYTE[_SPACE] = 0
_BASE = np.uint64(0xD6E8FEB86659FD93)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_STEP_BYTES = 1 << 20


def _powers(base: np.uint64, count: int) -> np.ndarray:
    powers = np.full(count, base, np.uint64)
    powers[0] = 1
    return np.cumprod(powers, dtype=np.uint64)


def mixed(values: np.ndarray, salt: int = 0) -> np.ndarray:
    """The values scrambled, one to one."""
    x = values + np.uint64((salt * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) % (1 << 64))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts and where each begins; null is empty."""
    texts = pa.array([], pa.large_string()) if not len(texts) else texts.cast(pa.large_string())
    texts = texts.fill_null("")
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    _, offsets, data = texts.buffers()
    begins = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole, begins


def word_hashes(texts: pa.Array, fold: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hash of every word, number of words of each text).

    A-Z count as small letters unless `fold` is false.

    A word's hash is a sum over its bytes, each times a power of an odd base by its place: sums
    from the first byte of the step are divided by the power of the word's own start, so all
    words of a step are hashed at once. Steps end between texts, so a long text has its own.
    """
    if not len(texts):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    data, begins = _bytes(texts)
    byte = _BYTE if fold else _EXACT_BYTE
    counts = np.zeros(len(texts), np.int64)
    found = []
    first = 0
    power = inverse = np.zeros(0, np.uint64)
    while first < len(texts):
        last = int(np.searchsorted(begins, begins[first] + _STEP_BYTES, "right")) - 1
        last = min(max(last, first + 1), len(texts))
        part = data[begins[first] : begins[last]]
        if len(part):
            if len(power) < len(part):
                power, inverse = _powers(_BASE, len(part)), _powers(_INVERSE, len(part))
            inside = begins[first : last + 1] - begins[first]
            word = ~_SPACE[part]
            start = word.copy()
            start[1:] &= ~word[:-1]
            edges = inside[:-1][inside[:-1] < len(part)]
            start[edges] = word[edges]
            starts = np.flatnonzero(start)
            counts[first:last] = np.diff(np.searchsorted(starts, inside))
            if len(starts):
                sums = np.add.reduceat(byte[part] * power[: len(part)], starts)
                found.append(mixed(sums * inverse[starts]))
        first = last
    return (np.concatenate(found) if found else np.zeros(0, np.uint64)), counts


def slices(texts: pa.Array, size: int) -> Iterator[tuple[int, int]]:
    """(first, last) of runs of texts of about so many bytes; a longer text is one by itself."""
    _, begins = _bytes(texts)
    first = 0
    while first < len(texts):
        last = int(np.searchsorted(begins, begins[first] + size, "right")) - 1
        last = min(max(last, first + 1), len(texts))
        yield first, last
        first = last


class RangeHashes:
    """Hashes of any run of words, from sums over the words times powers of an odd base."""

    def __init__(self, words: np.ndarray):
        self.inverse = _powers(_INVERSE, len(words) + 1)
        sums = np.cumsum(words * _powers(_BASE, len(words) + 1)[:-1], dtype=np.uint64)
        self.sums = np.concatenate([np.zeros(1, np.uint64), sums])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """A 64-bit hash of the words from each start to each end (exclusive)."""
        found = (self.sums[ends] - self.sums[starts]) * self.inverse[starts]
        return mixed(found, 31) + (ends - starts).astype(np.uint64)
