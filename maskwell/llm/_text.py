"""Vectorised token and shingle hashing over UTF-8 bytes.

Words are runs of bytes other than 0x20 and 0x09-0x0D. A word's hash is a
polynomial over randomised byte values modulo 2**64, taken as a difference of
prefix sums, so that a whole batch of documents is hashed without a Python
loop over words. Texts longer than ``PIECE`` bytes are cut at white space, so
temporary arrays stay bounded whatever a document's length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

PIECE = 1 << 20
U64 = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift-multiply), in place on a copy."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def random_u64(n: int, seed: int) -> np.ndarray:
    """``n`` fixed pseudo-random values."""
    with np.errstate(over="ignore"):
        return mix((np.arange(1, n + 1, dtype=U64) + U64(seed) * U64(1 << 32)) * U64(0x9E3779B97F4A7C15))


SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: All ASCII but letters and digits: words without punctuation.
NOT_ALNUM = np.array([i < 128 and not chr(i).isalnum() for i in range(256)])
_LOWER = np.arange(256)
_LOWER[65:91] += 32
_VALUES = random_u64(256, 11)
_FOLDED = _VALUES[_LOWER]
_BASE = U64(0xD6E8FEB86659FD93)
_BASE_INVERSE = U64(pow(int(_BASE), -1, 1 << 64))
_powers: list[np.ndarray] = []


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, PIECE + 1)
        with np.errstate(over="ignore"):
            _powers[:] = [
                np.concatenate([[U64(1)], np.cumprod(np.full(size, base, U64), dtype=U64)])
                for base in (_BASE, _BASE_INVERSE)
            ]
    return _powers[0], _powers[1]


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column and the rows' offsets into them; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_large_string(column.type) and not pa.types.is_large_binary(column.type):
        column = column.cast(pa.large_binary() if pa.types.is_binary(column.type) else pa.large_string())
    if column.null_count:
        column = column.fill_null("" if pa.types.is_large_string(column.type) else b"")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    values = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    if not len(at):
        at = np.zeros(1, np.int64)
    return values[at[0] : at[-1]], at - at[0]


def row_slices(offsets: np.ndarray, most: int = PIECE) -> Iterator[tuple[int, int]]:
    """Runs of rows of at most ``most`` bytes together (a longer row stands alone)."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def word_spans(data: np.ndarray, offsets: np.ndarray, gaps: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Byte starts and ends of the words; words end with their row."""
    if not len(data):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    gap = gaps[data]
    before = np.empty(len(data), bool)
    before[0], before[1:] = True, gap[:-1]
    after = np.empty(len(data), bool)
    after[-1], after[:-1] = True, gap[1:]
    filled = offsets[1:] > offsets[:-1]
    before[offsets[:-1][filled]] = True
    after[offsets[1:][filled] - 1] = True
    word = ~gap
    return np.flatnonzero(word & before), np.flatnonzero(word & after) + 1


def _hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, values: np.ndarray) -> np.ndarray:
    up, down = _power_tables(len(data))
    with np.errstate(over="ignore"):
        total = np.zeros(len(data) + 1, U64)
        np.cumsum(values[data] * up[: len(data)], dtype=U64, out=total[1:])
        return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(U64))


def word_hashes(data: np.ndarray, offsets: np.ndarray, gaps: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, A-Z as a-z, and the rows' offsets into them."""
    values = _FOLDED
    if len(offsets) == 2 and len(data) > 2 * PIECE:
        parts, at = [], 0
        while at < len(data):
            end = min(len(data), at + PIECE)
            while end < len(data):
                breaks = np.flatnonzero(gaps[data[at:end]])
                if len(breaks):
                    end = at + int(breaks[-1]) + 1
                    break
                end = min(len(data), end + PIECE)
            piece = data[at:end]
            starts, ends = word_spans(piece, np.array([0, len(piece)]), gaps)
            parts.append(_hash_spans(piece, starts, ends, values))
            at = end
        words = np.concatenate(parts)
        return words, np.array([0, len(words)])
    starts, ends = word_spans(data, offsets, gaps)
    words = _hash_spans(data, starts, ends, values) if len(starts) else np.empty(0, U64)
    return words, np.searchsorted(starts, offsets)


def shingles(words: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``k`` words (not yet distinct) and the rows' offsets.

    A row of 1 to k-1 words has one shingle, its whole sequence; a row without
    words has none.
    """
    rows, n = len(offsets) - 1, len(words)
    salts = random_u64(k, 23) | U64(1)
    count = np.diff(offsets)
    with np.errstate(over="ignore"):
        full = np.zeros(max(0, n - k + 1), U64)
        for i in range(k):
            full += words[i : n - k + 1 + i] * salts[i]
        full = mix(full)
    each = np.where(count >= k, count - k + 1, np.minimum(count, 1))
    at = np.concatenate([[0], np.cumsum(each)]).astype(np.int64)
    if (count >= k).all() or not rows:
        keep = np.arange(at[-1]) + np.repeat(offsets[:-1] - at[:-1], each) if rows else np.empty(0, np.int64)
        return full[keep], at
    out = np.empty(at[-1], U64)
    long = count >= k
    dest = np.repeat(long, each)
    source = np.arange(at[-1]) + np.repeat(offsets[:-1] - at[:-1], each)
    out[dest] = full[source[dest]]
    with np.errstate(over="ignore"):
        for r in np.flatnonzero((count > 0) & ~long):
            mine = words[offsets[r] : offsets[r + 1]]
            out[at[r]] = mix(np.array([(mine * salts[: len(mine)]).sum(dtype=U64) + U64(len(mine) << 40)]))[0]
    return out, at


def shingle_sets(column: pa.Array, k: int) -> Iterator[np.ndarray]:
    """Each row's distinct shingle hashes, sorted."""
    data, offsets = utf8(column)
    for i, j in row_slices(offsets):
        words, at = word_hashes(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        values, at = shingles(words, at, k)
        for r in range(j - i):
            yield np.unique(values[at[r] : at[r + 1]])
