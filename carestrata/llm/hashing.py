"""Hashes of the words of many texts at once, computed on the UTF-8 bytes of an Arrow column.

A word is a run of bytes other than space and 0x09-0x0D. Its hash is a polynomial in a fixed random
table of byte values, taken from running sums, so no Python object is made per word.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from carestrata.llm.memory import only

BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
#: Text whose words are hashed at once; the tables of powers and all arrays of a piece stay within a core's cache.
BYTES_AT_ONCE = 1 << 18

_bytes = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_lower = _bytes.copy()
_lower[65:91] = _bytes[97:123]
_space = np.zeros(256, bool)
_space[[9, 10, 11, 12, 13, 32]] = True


def mix(h: np.ndarray) -> np.ndarray:
    """Spread every input bit over the whole 64-bit word."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def _up_to(n: int) -> tuple[np.ndarray, np.ndarray]:
    """At least n powers of the base and of its inverse."""
    kept = only("powers", dict)
    if len(kept.get(BASE, ())) < n:
        for factor in (BASE, INVERSE):
            steps = np.full(max(n, BYTES_AT_ONCE + 1), factor, np.uint64)
            steps[0] = 1
            kept[factor] = np.multiply.accumulate(steps)
    return kept[BASE], kept[INVERSE]


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts (null: empty) and the offsets between them."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0]:offsets[-1]], offsets - offsets[0]


def pieces(column: pa.Array, limit: int = BYTES_AT_ONCE):
    """Cut a column of texts into runs of whole texts of about ``limit`` bytes: (first row, bytes, offsets)."""
    data, offsets = text_bytes(column)
    row, rows = 0, len(offsets) - 1
    while row < rows:
        end = int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1
        end = min(max(end, row + 1), rows)
        yield row, data[offsets[row]:offsets[end]], offsets[row:end + 1] - offsets[row]
        row = end


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold_case: bool = False) -> np.ndarray:
    """Hash of each byte range."""
    powers, inverses = _up_to(len(data) + 1)
    values = (_lower if fold_case else _bytes)[data]
    values *= powers[:len(data)]
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(values, out=sums[1:])
    lengths = (ends - starts).astype(np.uint64)
    return mix((sums[ends] - sums[starts]) * inverses[starts] + lengths * np.uint64(0xD1B54A32D192ED03))


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and per text the index of its first word (one entry more than texts)."""
    n = len(data)
    if not n:
        nothing = np.zeros(0, np.int64)
        return nothing, nothing, np.zeros(len(offsets), np.int64)
    word = ~_space[data]
    before = np.empty(n + 1, bool)
    before[0] = before[n] = False
    before[1:n] = word[:-1]
    before[offsets] = False
    after = np.empty(n + 1, bool)
    after[n] = False
    after[:n] = word
    after[offsets] = False
    starts = np.flatnonzero(word & ~before[:n])
    ends = np.flatnonzero(word & ~after[1:]) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def shingles(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of every ``size`` consecutive entries, one for each start."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for i in range(size):
        total *= np.uint64(BASE)
        total += hashes[i:i + n]
    return mix(total)


def signed(values: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(values).view(np.int64)
