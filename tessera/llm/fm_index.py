"""A compressed full-text index of word sequences: a Huffman-shaped wavelet tree over the transform of one shard.

Suffixes are sorted by their first ORDER symbols (by doubling), which is all that searches of up to ORDER symbols
need. The transform is kept as a wavelet tree in the shape of its symbols' Huffman code, level by level: a bitmap of
the bits of those codes that reach the level, with a directory of the ones before each 64 bits. So it takes about as
many bits for a symbol as the zero-order entropy. Codes are canonical, so the tree's nodes of a level are numbered in
a row. Weights are kept where they aren't 1. Backward search prepends a symbol by two ranks for each bit of its code.
All searches of a shard run in step as numpy vectors.
"""

from __future__ import annotations

import numpy as np

#: Longest pattern.
ORDER = 64
_ONE = np.uint64(1)


def _ranked(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(key)
    step = np.empty(len(key), np.int64)
    step[0] = 0
    ordered = key[order]
    np.cumsum(ordered[1:] != ordered[:-1], out=step[1:])
    rank = np.empty(len(key), np.int64)
    rank[order] = step
    return rank, order


def code_lengths(counts: np.ndarray) -> np.ndarray:
    """Bits of the Huffman code of each symbol; at least one."""
    n = len(counts)
    order = np.argsort(counts, kind="stable")
    leaves, trees, up = counts[order].tolist(), [], [0] * (2 * n - 1)
    leaf = tree = 0
    for new in range(n, 2 * n - 1):
        total = 0
        for _ in range(2):
            if leaf < n and (tree >= len(trees) or leaves[leaf] <= trees[tree]):
                total, up[leaf], leaf = total + leaves[leaf], new, leaf + 1
            else:
                total, up[n + tree], tree = total + trees[tree], new, tree + 1
        trees.append(total)
    depth = [0] * (2 * n - 1)
    for i in range(2 * n - 3, -1, -1):
        depth[i] = depth[up[i]] + 1
    out = np.empty(n, np.int64)
    out[order] = depth[:n]
    return np.maximum(1, out)


class Bits:
    """A bitmap with ranks."""

    def __init__(self, bits: np.ndarray):
        self.words = np.zeros(len(bits) // 64 + 1, np.uint64)
        packed = np.packbits(bits, bitorder="little")
        self.words.view(np.uint8)[: len(packed)] = packed
        self.ones = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)])[:-1].astype(np.int32)

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ones before each place."""
        word = at >> 6
        return self.ones[word] + np.bitwise_count(self.words[word] & ((_ONE << (at & 63).astype(np.uint64)) - _ONE))


class Index:
    """An index of symbols 0..sigma - 1, each of which occurs; 0 separates sequences and is in no pattern.

    weight: of each place.
    """

    def __init__(self, symbols: np.ndarray, sigma: int, weight: np.ndarray):
        n = len(symbols)
        rank, order = _ranked(symbols.astype(np.int64))
        h = 1
        while h < ORDER and rank[order[-1]] < n - 1:
            after = np.zeros(n, np.int64)
            after[: n - h] = rank[h:] + 1
            rank, order = _ranked(rank * np.int64(n + 1) + after)
            h *= 2
        counts = np.bincount(symbols, minlength=sigma)
        self.n, self.before = n, np.concatenate([[0], np.cumsum(counts)])
        ordered = weight[order]
        self.heavy = Bits(ordered != 1)
        self.extra = np.concatenate([[0], np.cumsum(ordered[ordered != 1] - 1)])
        self._tree(symbols[order - 1], counts)

    def _tree(self, seq: np.ndarray, counts: np.ndarray) -> None:
        self.length = code_lengths(counts)
        depth = int(self.length.max())
        many = np.bincount(self.length, minlength=depth + 1)
        first = np.zeros(depth + 2, np.int64)  # the first code of each length
        for k in range(1, depth + 1):
            first[k] = (first[k - 1] + many[k - 1]) << 1
        by_length = np.argsort(self.length, kind="stable")
        self.code = np.empty(len(counts), np.int64)
        self.code[by_length] = first[self.length[by_length]] + np.arange(len(counts)) - np.concatenate([[0], np.cumsum(many)])[self.length[by_length]]
        self.levels = []  # bitmap, number of the first node that isn't a leaf, and where each node starts, in places and in ones
        for k in range(depth):
            code, left = self.code[seq], self.length[seq] - k
            low = int(first[k] + many[k]) if k else 0
            node, bit = (code >> left) - low, (code >> (left - 1)) & 1
            size, ones = np.bincount(node), np.bincount(node, weights=bit).astype(np.int64)
            starts, ones_before = np.cumsum(size) - size, np.cumsum(ones) - ones
            self.levels.append((Bits(bit.astype(np.bool_)), low, starts, ones_before))
            nth = np.cumsum(bit) - bit - ones_before[node]  # ones of the node before each place
            to = np.where(bit == 1, starts[node] + (size - ones)[node] + nth, np.arange(len(seq)) - nth)
            after = np.empty_like(seq)
            after[to] = seq
            seq = after[self.length[after] > k + 1]

    def occurrences(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each place of the transform; at: several rows of places."""
        out, live = at.copy(), None
        length, code = self.length[symbol], self.code[symbol]
        for k, (bits, low, starts, ones) in enumerate(self.levels):
            if k:
                go = length > k
                if not go.all():
                    length, code = length[go], code[go]
                    live = np.flatnonzero(go) if live is None else live[go]
                if not len(code):
                    break
            node = (code >> (length - k)) - low
            here = out if live is None else out[:, live]
            rank = bits.rank(starts[node] + here) - ones[node]
            now = np.where((code >> (length - k - 1)) & 1, rank, here - rank)
            if live is None:
                out = now
            else:
                out[:, live] = now
        return out

    def extend(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of symbol + pattern, from those of the patterns."""
        both = self.occurrences(symbol, np.stack([low, high])) + self.before[symbol]
        return both[0], both[1]

    def count(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        return high - low + self.extra[self.heavy.rank(high)] - self.extra[self.heavy.rank(low)]


def repeated(coded: np.ndarray, lengths: np.ndarray, weights: np.ndarray, size: int, gram: int = 3) -> list[np.ndarray]:
    """For each sequence: whether each window of `size` symbols occurs twice or more, by weight.

    coded: numbers 0.. of the words of all sequences, one after another; each sequence has size to ORDER words.
    Each window of the corpus must lie in one of them only.
    """
    starts = np.concatenate([[0], np.cumsum(lengths + 1)])
    total = int(starts[-1])
    place = np.ones(total, np.bool_)
    place[starts[1:] - 1] = False
    symbols = np.zeros(total, np.int64)
    symbols[place] = coded + 1
    index = Index(symbols, int(coded.max(initial=-1)) + 2, np.repeat(weights, lengths + 1))

    out = [np.zeros(n, np.bool_) for n in (lengths - size + 1).tolist()]
    # grams that occur once rule out all windows that hold them; a sequence with copies has none
    asked = np.flatnonzero(weights < 2)
    counts = lengths[asked] - gram + 1
    at = np.repeat(starts[asked], counts) + np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    low, high = np.zeros(len(at), np.int64), np.full(len(at), index.n, np.int64)
    for k in reversed(range(gram)):
        low, high = index.extend(symbols[at + k], low, high)
    once = index.count(low, high) < 2
    # the rest, block by block from the right: the longest repeated suffix of each block's words
    sure = np.flatnonzero(weights >= 2)
    block_of, block_low, block_high = sure.tolist(), [0] * len(sure), (lengths[sure] - size).tolist()
    ends = np.cumsum(counts)
    for nth, a, b in zip(asked.tolist(), ends - counts, ends, strict=True):
        bad = np.concatenate([[0], np.cumsum(once[a:b])])
        n = len(out[nth])
        good = bad[size - gram + 1 : size - gram + 1 + n] == bad[:n]
        edge = np.flatnonzero(np.diff(np.concatenate([[0], good, [0]])))
        for i, j in zip(edge[::2], edge[1::2], strict=True):
            block_of.append(nth)
            block_low.append(i)
            block_high.append(j - 1)
    of, lo, hi = (np.array(x, np.int64) for x in (block_of, block_low, block_high))  # windows lo..hi are open
    while len(of):
        origin = starts[of]
        at, stop = origin + hi + size, origin + lo  # one past the block's last word, and its first
        low, high = np.zeros(len(of), np.int64), np.full(len(of), index.n, np.int64)
        reach, live = at.copy(), np.arange(len(of))
        while len(live):
            new_low, new_high = index.extend(symbols[reach[live] - 1], low[live], high[live])
            ok = index.count(new_low, new_high) >= 2
            live, new_low, new_high = live[ok], new_low[ok], new_high[ok]
            reach[live] -= 1
            low[live], high[live] = new_low, new_high
            live = live[reach[live] > stop[live]]
        first = reach - origin  # matching statistic: words first.. of the block are repeated as a whole
        for b in np.flatnonzero(first <= hi):
            out[of[b]][first[b] : hi[b] + 1] = True
        hi = np.minimum(first, hi) - 1
        keep = hi >= lo
        of, lo, hi = of[keep], lo[keep], hi[keep]
    return out
