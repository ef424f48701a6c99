"""Vectorised word and shingle hashing over the UTF-8 bytes of Arrow string batches.

Everything here works on one bounded slice of a batch at a time, so memory does not depend on
how long the texts of a partition are; one text longer than the slice is a slice of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 18
_MULT = np.uint64(0x9E3779B97F4A7C15)
_SEED = 20240229

#: Word separators: space and the ASCII controls 9 to 13.
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
#: A-Z to a-z, every other byte unchanged.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: ASCII punctuation.
PUNCT = np.zeros(256, bool)
PUNCT[33:48] = PUNCT[58:65] = PUNCT[91:97] = PUNCT[123:127] = True
#: Letters: A-Z, a-z and every byte of a multi-byte character.
LETTER = np.zeros(256, bool)
LETTER[65:91] = LETTER[97:123] = LETTER[128:] = True

_BYTE = np.random.default_rng(_SEED).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS["up"]) < n:
        n = max(n, SLICE_BYTES + 1)
        inverse = np.uint64(pow(int(_MULT), -1, 1 << 64))
        for name, base in (("up", _MULT), ("down", inverse)):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            _POWERS[name] = np.multiply.accumulate(steps)
    return _POWERS["up"], _POWERS["down"]


def mix(h: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, elementwise."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, row offsets into them) of runs of rows of about limit bytes; null is empty."""
    texts = texts.fill_null("").cast(pa.large_string())
    n = len(texts)
    if not n:
        return
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    row = 0
    while row < n:
        end = int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1
        end = min(n, max(end, row + 1))
        yield row, end, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def without(data: np.ndarray, offsets: np.ndarray, drop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes without those of the table drop, and the row offsets into what stays."""
    keep = ~drop[data]
    return data[keep], np.concatenate(([0], np.cumsum(keep)))[offsets]


def words(data: np.ndarray, offsets: np.ndarray, separator: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of bytes that separate nothing, and the index of the first word of each row."""
    inside = np.concatenate(([False], ~separator[data], [False]))
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    starts = np.flatnonzero(inside[1:-1] & (~inside[:-2] | edge[:-1]))
    ends = np.flatnonzero(inside[1:-1] & (~inside[2:] | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: np.ndarray = LOWER) -> np.ndarray:
    """A 64-bit hash of each word's bytes after the table fold."""
    up, down = _powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[fold][data] * up[: len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def shingles(hashes: np.ndarray, first: np.ndarray, size: int, short: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of size words of each row, in order, and the index of the first of each row.

    short: a row with fewer words has its whole sequence as one shingle; a row with none has none.
    """
    n = np.diff(first)
    rows, at = np.repeat(np.arange(len(n)), n), np.arange(len(hashes))
    length = np.minimum(size, n[rows]) if short else np.full(len(hashes), size)
    whole = at + length <= first[1:][rows]
    whole &= (length == size) | (at == first[:-1][rows])
    at, length = at[whole], length[whole]
    out = mix(length.astype(np.uint64))
    for k in range(size):
        has = length > k
        if has.all():
            out = mix(out * _MULT + hashes[at + k])
        else:
            out[has] = mix(out[has] * _MULT + hashes[at[has] + k])
    return out, np.searchsorted(rows[whole], np.arange(len(n) + 1))
