"""Directly addressable codes: a compressed sequence of ids with random access to any of them.

An id is cut into chunks of `bits` bits, lowest first. Level k holds the k-th chunk of all ids that have
one, with a bitmap that says which of them continue on level k + 1. A directory of the bitmap's ones
before each block of 512 bits turns a position on one level into the position on the next, so id i is
read by at most `levels` look-ups, and no block is decoded.

Layout of a segment, all little-endian: magic, u8 bits, u8 levels, u64 ids, u64 documents; then the
documents' keys (i64), null flags (u8) and starts (u64, one more than documents); then for each level u64
entries, its chunks (u8, or u16 above 8 bits) and, but for the last, u64 words of bitmap and u32 ranks.
"""

from __future__ import annotations

import struct

import numpy as np

MAGIC = b"TDAC1\0"
_HEAD = struct.Struct("<6sBBQQ")
#: Words of bitmap between two entries of the rank directory.
_WORDS = 8


def _pad(raw: bytes) -> bytes:
    return raw + bytes(-len(raw) % 8)


def pack(ids: np.ndarray, keys: list[int | None], starts: np.ndarray, bits: int = 8) -> bytes:
    """A segment: ids of whole documents, one after another."""
    if not 1 <= bits <= 16:
        raise ValueError("bits must be 1 to 16")
    kind, rest, levels = (np.uint8 if bits <= 8 else np.uint16), ids.astype(np.uint64), []
    mask = np.uint64((1 << bits) - 1)
    while True:
        chunk, rest = (rest & mask).astype(kind), rest >> np.uint64(bits)
        more = rest > 0
        last = not more.any()
        levels.append((chunk, None if last else more))
        if last:
            break
        rest = rest[more]
    out = [_HEAD.pack(MAGIC, bits, len(levels), len(ids), len(keys))]
    out.append(np.array([0 if k is None else k for k in keys], "<i8").tobytes())
    out.append(_pad(np.array([k is None for k in keys], np.uint8).tobytes()))
    out.append(np.asarray(starts, "<u8").tobytes())
    for chunk, more in levels:
        out += [struct.pack("<Q", len(chunk)), _pad(chunk.astype(chunk.dtype.newbyteorder("<")).tobytes())]
        if more is not None:
            words = np.zeros(-(-len(more) // 64), "<u8")
            packed = np.packbits(more, bitorder="little")
            words.view(np.uint8)[: len(packed)] = packed
            ones = np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.uint64)])
            out += [words.tobytes(), _pad(ones[:-1:_WORDS].astype("<u4").tobytes())]
    return b"".join(out)


class Segment:
    """A reader. Nothing is decoded before it is asked for."""

    def __init__(self, raw: bytes):
        magic, self.bits, levels, self.n, docs = _HEAD.unpack_from(raw)
        if magic != MAGIC:
            raise ValueError("no segment of directly addressable codes")
        at = _HEAD.size

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(raw, kind, n, at)
            at += -(-out.nbytes // 8) * 8
            return out

        keys, nulls = take("<i8", docs), take("u1", docs)
        self.keys = [None if z else int(k) for k, z in zip(keys, nulls, strict=True)]
        self.starts = take("<u8", docs + 1).astype(np.int64)
        self.levels = []
        for k in range(levels):
            n = int(take("<u8", 1)[0])
            chunk = take("u1" if self.bits <= 8 else "<u2", n)
            self.levels.append((chunk, *((take("<u8", -(-n // 64)), take("<u4", -(-n // (64 * _WORDS)))) if k + 1 < levels else (None, None))))

    @staticmethod
    def _rank(words: np.ndarray, ranks: np.ndarray, i: int) -> int:
        """Ones before bit i."""
        block, word = i // (64 * _WORDS), i // 64
        n = int(ranks[block]) if block < len(ranks) else int(ranks[-1]) + int(np.bitwise_count(words[(len(ranks) - 1) * _WORDS :]).sum())
        if block < len(ranks):
            n += int(np.bitwise_count(words[block * _WORDS : word]).sum())
            if i % 64:
                n += (int(words[word]) & ((1 << i % 64) - 1)).bit_count()
        return n

    def __getitem__(self, i: int) -> int:
        """Id i, by one look-up on each level that it has."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for k, (chunk, words, ranks) in enumerate(self.levels):
            value |= int(chunk[i]) << (k * self.bits)
            if words is None or not (int(words[i // 64]) >> (i % 64)) & 1:
                break
            i = self._rank(words, ranks, i)
        return value

    def slice(self, start: int, stop: int) -> np.ndarray:
        """Ids start:stop as uint32 (uint64 if they need it); reads no other entries."""
        lo, hi = start, stop
        out = np.zeros(stop - start, np.uint64)
        at = None  # places in out of the ids that are still open
        for k, (chunk, words, ranks) in enumerate(self.levels):
            part = chunk[lo:hi].astype(np.uint64) << np.uint64(k * self.bits)
            if at is None:
                out |= part
            else:
                out[at] |= part
            if words is None or lo == hi:
                break
            first = lo // 64
            more = np.unpackbits(words[first : -(-hi // 64)].view(np.uint8), bitorder="little")[lo - first * 64 : hi - first * 64].view(np.bool_)
            at = np.flatnonzero(more) if at is None else at[more]
            lo = self._rank(words, ranks, lo)
            hi = lo + len(at)
        return out.astype("<u4") if len(self.levels) * self.bits <= 32 or not len(out) or int(out.max()) < 1 << 32 else out
