"""Words, shingles and hashes of whole text batches, as numpy arrays.

Texts come as an Arrow string column. All bytes of a block of texts are looked
at together: a table says which bytes belong to words, prefix sums of a
polynomial give the 64-bit hash of any word or run of words. A null text has
no words.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

#: Texts are taken together up to so many bytes; a longer text is a block of its own.
BLOCK_BYTES = 1 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Bytes of words between white space.
NOT_SPACE = ~_SPACE
#: Bytes of words of lower-cased letters, digits and all characters beyond ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True

LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20

_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = {"byte": 0x9E3779B97F4A7C15 | 3, "word": 0xD6E8FEB86659FD93 | 3}
_POWERS: dict[str, tuple[np.ndarray, np.ndarray]] = {}


def _powers(kind: str, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n of the base and of its inverse, modulo 2**64."""
    have = _POWERS.get(kind)
    if have is None or len(have[0]) <= n:
        size = max(n + 1, BLOCK_BYTES + 1)
        base = _BASE[kind]
        both = []
        for b in (base, pow(base, -1, 1 << 64)):
            out = np.full(size, b, np.uint64)
            out[0] = 1
            both.append(np.cumprod(out))
        have = (both[0], both[1])
        if size <= 4 * BLOCK_BYTES:
            _POWERS[kind] = have
    return have


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class Words(NamedTuple):
    """Words of a block: ``first[d]:first[d + 1]`` are those of text ``d``."""

    first: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    data: np.ndarray

    def bytes_of(self, i: int) -> bytes:
        return self.data[self.start[i] : self.end[i]].tobytes()


def _buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    if texts.null_count:
        texts = texts.fill_null("")
    wide = pa.types.is_large_string(texts.type)
    _, off, data = texts.buffers()
    n = len(texts)
    offsets = np.frombuffer(off, np.int64 if wide else np.int32)[texts.offset : texts.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return offsets, raw


def blocks(texts: pa.Array, is_word: np.ndarray, lower: bool, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int, Words]]:
    """(first row, row after the last, words) of each block of texts."""
    if len(texts) == 0:
        return
    offsets, raw = _buffers(texts)
    row, n = 0, len(texts)
    while row < n:
        last = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1)
        yield row, last, _split(raw[offsets[row] : offsets[last]], offsets[row : last + 1] - offsets[row], is_word, lower)
        row = last


def _split(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray, lower: bool) -> Words:
    n = len(data)
    if lower:
        data = LOWER[data]
    if n == 0:
        none = np.zeros(0, np.int64)
        return Words(np.zeros(len(offsets), np.int64), none, none, np.zeros(0, np.uint64), data)
    inside = np.zeros(n + 2, bool)
    inside[1:-1] = is_word[data]
    begins = np.zeros(n + 1, bool)
    begins[offsets] = True
    here, before = inside[1:], inside[:-1]
    start = np.flatnonzero(here & (~before | begins))
    end = np.flatnonzero(before & (~here | begins))
    power, inverse = _powers("byte", n)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[data] * power[:n], out=sums[1:])
    hashes = mix((sums[end] - sums[start]) * inverse[start] + (end - start).astype(np.uint64))
    return Words(np.searchsorted(start, offsets), start, end, hashes, data)


def gram_hashes(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of ``k`` consecutive words (across texts too)."""
    n = len(hashes)
    if n < k:
        return np.zeros(0, np.uint64)
    power, inverse = _powers("word", n)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(hashes * power[:n], out=sums[1:])
    return mix((sums[k:] - sums[:-k]) * inverse[: n - k + 1] + np.uint64(k))


def run_hash(hashes: np.ndarray) -> np.uint64:
    """Hash of one whole sequence of words."""
    return gram_hashes(hashes, len(hashes))[0]


def shingle_sets(words: Words, k: int) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text; fewer words than ``k`` are one shingle."""
    grams = gram_hashes(words.hash, k)
    for lo, hi in zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True):
        if hi - lo >= k:
            s = np.sort(grams[lo : hi - k + 1])
            if len(s) > 1:
                keep = np.empty(len(s), bool)
                keep[0] = True
                np.not_equal(s[1:], s[:-1], out=keep[1:])
                s = s[keep]
            yield s
        elif hi > lo:
            yield gram_hashes(words.hash[lo:hi], hi - lo)
        else:
            yield grams[:0]


def signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)


def span_hashes(hashes: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of each run of words from ``start`` to before ``end``."""
    n = len(hashes)
    power, inverse = _powers("word", n)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(hashes * power[:n], out=sums[1:])
    return mix((sums[end] - sums[start]) * inverse[start] + (end - start).astype(np.uint64))


def prefix_hashes(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(word, hash of its first ``k`` bytes) of each word longer than that; unlike the hash of any whole word."""
    long = np.flatnonzero(words.end - words.start > k)
    n = len(words.data)
    power, inverse = _powers("byte", n)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[words.data] * power[:n], out=sums[1:])
    start = words.start[long]
    return long, mix(((sums[start + k] - sums[start]) * inverse[start]) ^ np.uint64(0x5851F42D4C957F2D * k & (1 << 64) - 1))
