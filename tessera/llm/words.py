"""Words of whole Arrow batches, found and hashed with numpy on the UTF-8 bytes themselves.

No Python object is made per word but for very long ones. Bytes of one character above U+007F are all >= 0x80, so
classes of ASCII separators can be looked up byte by byte.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash

#: Bytes of the longest word whose hash is made beside others; a longer one is hashed by itself.
SHORT = 64
#: Texts of one call; a batch is cut into runs of about this many bytes.
RUN_BYTES = 1 << 20

_P = np.uint64(0x9E3779B97F4A7C15 | 1)
_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)

#: Separators of the corpus contracts: [\x20\x09-\x0D].
SPACE = np.zeros(256, np.bool_)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Everything that is not [0-9a-z] or beyond ASCII, after A-Z have been lower-cased.
NON_ALNUM = np.ones(256, np.bool_)
NON_ALNUM[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * _MIX1
    x = x ^ (x >> np.uint64(27))
    x = x * _MIX2
    return x ^ (x >> np.uint64(31))


_SEED = np.uint64(0x243F6A8885A308D3)
#: Lowest 0 to 8 bytes of a long.
_BYTES = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as one long; zeros follow the last byte."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    return np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))


def hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of each data[start:end]: eight bytes a round through a bijective mixer, XXH64 for long ones.

    Different words of one length up to eight bytes never share a hash.
    """
    loads, size = eights(data), end - start
    key = size.astype(np.uint64) * _P ^ _SEED
    for at in range(0, min(SHORT, int(size.max(initial=0))), 8):
        left = size - at
        if at == 0:
            key = mix(key ^ (loads[start] & _BYTES[np.minimum(left, 8)])) * _P
        else:
            some = np.flatnonzero(left > 0)
            key[some] = mix(key[some] ^ (loads[start[some] + at] & _BYTES[np.minimum(left[some], 8)])) * _P
    for i in np.flatnonzero(size > SHORT).tolist():
        key[i] = xxhash.xxh64_intdigest(data[start[i] : end[i]].tobytes(), 17)
    return key


@dataclass
class Words:
    """Words of several texts, in order."""

    data: np.ndarray  # the bytes that start and end point into
    start: np.ndarray  # int64, in bytes
    end: np.ndarray
    key: np.ndarray  # uint64 hash of each word
    first: np.ndarray  # int64 of len(texts) + 1: words of text i are first[i]:first[i + 1]

    def of(self, i: int) -> slice:
        return slice(int(self.first[i]), int(self.first[i + 1]))


def buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and int64 offsets of each text; null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    body = column.buffers()[2]
    data = np.frombuffer(body, np.uint8) if body is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def runs(offsets: np.ndarray, most: int = RUN_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about `most` bytes together, one text at least."""
    at, n = 0, len(offsets) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        yield at, min(to, n)
        at = min(to, n)


def words(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray = SPACE, lower: bool = False, hashed: bool = True) -> Words:
    """Maximal runs of bytes that are no separators, within each text."""
    if lower:
        data = LOWER[data]
    n = len(data)
    is_word = ~separators[data]
    before = np.empty(n, np.bool_)
    if n:
        before[0] = False
        before[1:] = is_word[:-1]
        before[offsets[:-1][offsets[:-1] < n]] = False  # a text's first byte continues no word
        start = np.flatnonzero(is_word & ~before)
        after = np.empty(n, np.bool_)
        after[-1] = False
        after[:-1] = is_word[1:] & before[1:]
        end = np.flatnonzero(is_word & ~after) + 1
    else:
        start = end = np.zeros(0, np.int64)
    first = np.searchsorted(start, offsets).astype(np.int64)
    key = hashes(data, start, end) if hashed else np.zeros(len(start), np.uint64)
    return Words(data, start, end, key, first)


def codes(w: Words) -> np.ndarray:
    """A number 0.. for each different word, settled by its bytes: hashes only bring equal words together."""
    _, lead, code = np.unique(w.key, return_index=True, return_inverse=True)
    first, loads, size = lead[code], eights(w.data), w.end - w.start
    same = bool((size == size[first]).all())
    for at in range(0, min(SHORT, int(size.max(initial=0))) if same else 0, 8):
        some = np.flatnonzero(size > at)
        differ = (loads[w.start[some] + at] ^ loads[w.start[first[some]] + at]) & _BYTES[np.minimum(size[some] - at, 8)]
        same = same and not differ.any()
    same = same and all(w.data[w.start[i] : w.end[i]].tobytes() == w.data[w.start[first[i]] : w.end[first[i]]].tobytes() for i in np.flatnonzero(size > SHORT).tolist())
    if same:
        return code
    known: dict[bytes, int] = {}
    return np.array([known.setdefault(w.data[a:b].tobytes(), len(known)) for a, b in zip(w.start.tolist(), w.end.tolist(), strict=True)], np.int64)


def one_spaced(w: Words) -> np.ndarray:
    """For each word, the words up to it that aren't followed by exactly one space and the next word."""
    odd = np.ones(len(w.start) + 1, np.int64)
    odd[0] = 0
    if len(w.start) > 1:
        odd[1:-1] = (w.start[1:] - w.end[:-1] != 1) | (w.data[np.minimum(w.end[:-1], len(w.data) - 1)] != 0x20)
    return np.cumsum(odd)


def passage(w: Words, odd: np.ndarray, a: int, b: int) -> bytes:
    """Words a..b - 1 joined by one space; odd: one_spaced(w)."""
    if odd[b - 1] == odd[a]:
        return w.data[w.start[a] : w.end[b - 1]].tobytes()
    return b" ".join(w.data[w.start[i] : w.end[i]].tobytes() for i in range(a, b))


def rolling(key: np.ndarray, size: int, seed: int = 0) -> np.ndarray:
    """Hash of each `size` consecutive keys; len(key) - size + 1 values, or none."""
    n = len(key) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        out = np.full(n, np.uint64(seed) + np.uint64(size), np.uint64)
        for k in range(size):
            out = (out ^ key[k : k + n]) * _P
            out ^= out >> np.uint64(29)
    return mix(out)
