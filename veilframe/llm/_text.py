"""Vectorised kernels over whole Arrow text columns.

Every kernel works on the raw UTF-8 bytes of a slice of documents (a *chunk*), so
that Python's cost is paid for a chunk and not for a word. Chunks hold about
``CHUNK_BYTES`` of text, and one document at least, so memory is bounded by that or by
the longest document. Nothing is ever cut to a prefix.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

CHUNK_BYTES = 1 << 20

_U = np.uint64
_rng = np.random.default_rng(20240229)
#: A random 64-bit value for each byte, and the odd base of the rolling hash.
_BYTE = _rng.integers(1, 2**64 - 1, 256, dtype=np.uint64)
_BASE = int(_rng.integers(1, 2**63, dtype=np.uint64)) * 2 + 1
_BASE &= 2**64 - 1
_COMBINE = _rng.integers(1, 2**63, 64, dtype=np.uint64) * _U(2) + _U(1)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True
#: Bytes of letters, with every byte of a multi-byte character counted as one.
LETTER = np.zeros(256, dtype=bool)
LETTER[65:91] = LETTER[97:123] = LETTER[128:] = True

_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values (xor-shift-multiply)."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i below n."""
    if len(_powers[0]) < n:
        size = 1 << (n - 1).bit_length()
        inverse = pow(_BASE, -1, 2**64)
        for k, base in enumerate((_BASE, inverse)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers[0][:n], _powers[1][:n]


def buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the n+1 offsets of its values; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "").cast(pa.large_string())
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at - at[0]


def chunks(offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of documents that hold ``limit`` bytes at most, or one document."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield lo, hi
        lo = hi


def text_chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, last, bytes, offsets) of each chunk of a column."""
    data, offsets = buffers(column)
    for lo, hi in chunks(offsets, limit):
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of True; no run crosses a document's edge."""
    n = len(inside)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    edge = offsets[offsets < n]
    first[edge] = inside[edge]
    edge = offsets[offsets > 0] - 1
    last[edge] = inside[edge]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spans of the maximal runs of bytes that are no ASCII white space."""
    return runs(~SPACE[data], offsets)


def prefix_hashes(data: np.ndarray, fold: np.ndarray = LOWER) -> np.ndarray:
    """n+1 prefix sums; ``span_hash`` reads any substring's hash from them."""
    up, _ = powers(len(data) + 1)
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[fold[data]] * up[: len(data)], out=out[1:])
    return out


def sequence_hashes(values: np.ndarray) -> np.ndarray:
    """The same over a sequence of 64-bit values."""
    up, _ = powers(len(values) + 1)
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of substrings; equal text gives an equal hash wherever it stands.

    Unequal text can be made that collides: for candidates that are confirmed later, and
    for statistics, not for the identity of a text.
    """
    _, down = powers(len(prefix))
    return mix((prefix[end] - prefix[start]) * down[start] + (end - start).astype(np.uint64) * _COMBINE[63])


def combine(parts: list[np.ndarray]) -> np.ndarray:
    """One hash of several, in order."""
    total = np.zeros_like(parts[0])
    for k, x in enumerate(parts):
        total = total + x * _COMBINE[k % 62]
    return mix(total)


def counts_by_doc(starts: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """n+1 positions in ``starts`` at which each document's spans begin."""
    return np.searchsorted(starts, offsets, "left")


def loads(data: np.ndarray, at: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The n bytes (8 at most, none if below 1) that begin at each place, as one number."""
    wide = np.ndarray(len(data) - 7, np.uint64, data, strides=(1,))
    n = np.clip(n, 0, 8)
    mask = np.where(n == 8, ~_U(0), (_U(1) << (n.astype(np.uint64) * _U(8) & _U(63))) - _U(1))
    return wide[np.where(n > 0, at, 0)] & np.where(n > 0, mask, _U(0))


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each span of bytes, which no pattern in the text makes collide.

    Up to 16 bytes are read as two whole numbers, so that the 128 bits differ before they
    are mixed; longer spans go to XXH3.
    """
    n = end - start
    padded = np.zeros(len(data) + 16, np.uint8)
    padded[: len(data)] = data
    one, two = loads(padded, start, n), loads(padded, start + 8, n - 8)
    size = n.astype(np.uint64)
    low = mix(one + mix(two ^ _COMBINE[0]) + size * _COMBINE[1])
    high = mix(two + mix(one ^ _COMBINE[2]) + size * _COMBINE[3])
    long = np.flatnonzero(n > 16)
    if len(long):
        raw = data.tobytes()
        each = b"".join(xxhash.xxh3_128_digest(raw[a:b]) for a, b in zip(start[long].tolist(), end[long].tolist(), strict=True))
        low[long], high[long] = np.frombuffer(each, np.uint64).reshape(-1, 2).T
    return low, high


def shingles(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """The distinct ``width``-word shingles of each document, as two 64-bit hashes each.

    Both lists are in order of the first hash. A document of fewer words has its whole
    sequence as its one shingle, and one without words has none.
    """
    start, end = words(data, offsets)
    word = word_hashes(LOWER[data], start, end)
    at = counts_by_doc(start, offsets)
    n = max(0, len(start) - width + 1)
    rolled = [combine([w[k : k + n] for k in range(width)]) if n else w[:0] for w in word]
    low, high = [], []
    for lo, hi in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if hi - lo >= width:
            each, first = np.unique(rolled[0][lo : hi - width + 1], return_index=True)
            low.append(each)
            high.append(rolled[1][lo : hi - width + 1][first])
        elif hi > lo:
            for out, w in zip((low, high), word, strict=True):
                out.append(combine([w[k : k + 1] for k in range(lo, hi)]))
        else:
            low.append(word[0][:0])
            high.append(word[1][:0])
    return low, high
