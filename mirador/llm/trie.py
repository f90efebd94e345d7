"""An n-gram trie in Elias-Fano levels, memory-mapped inside a task."""

from __future__ import annotations

import mmap
import tempfile
from dataclasses import dataclass

import numpy as np

#: Place of the n-th one in each byte.
NTH_BIT = np.array(
    [([b for b in range(8) if byte >> b & 1] + [0] * 8)[:8] for byte in range(256)], dtype=np.int64
)
#: The lowest and the highest bit of each byte of a word.
LOWEST, HIGHEST = np.uint64(0x0101010101010101), np.uint64(0x8080808080808080)


@dataclass
class EliasFano:
    """A sorted sequence of integers: low bits as whole bytes, high bits in unary.

    The unary part has a one for each element and a zero at the end of each high value; per
    64 bits, the number of zeros before them is kept to find a zero quickly.
    """

    size: int
    shift: int
    low: np.ndarray
    bits: np.ndarray
    zeros: np.ndarray

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        size = len(values)
        top = int(values[-1]) if size else 0
        wanted = max(0, (top // max(size, 1)).bit_length() - 1)
        shift = next(s for s in (0, 8, 16, 32, 48) if s >= wanted)
        kind = {0: np.uint8, 8: np.uint8, 16: np.uint16, 32: np.uint32, 48: np.uint64}[shift]
        values = values.astype(np.uint64)
        high = (values >> np.uint64(shift)).astype(np.int64)
        ones = high + np.arange(size)
        length = (int(high[-1]) + 1 if size else 1) + size
        raised = np.zeros(-(-length // 64) * 64, dtype=np.uint8)
        raised[ones] = 1
        bits = np.packbits(raised, bitorder="little").view(np.uint64)
        zeros = np.concatenate([[0], np.cumsum(64 - np.bitwise_count(bits).astype(np.int64))])
        return cls(size, shift, (values & np.uint64((1 << shift) - 1)).astype(kind), bits, zeros)

    def bit(self, before: np.ndarray, number: np.ndarray, value: int) -> np.ndarray:
        """Places of the bits of a value with these numbers, given how many come before each word."""
        word = np.minimum(np.searchsorted(before, number, side="right") - 1, len(self.bits) - 1)
        held = self.bits[word] if value else ~self.bits[word]
        nth = np.minimum(number - before[word], 127).astype(np.uint64)
        until = np.bitwise_count(held.view(np.uint8)).view(np.uint64) * LOWEST  # in each byte, the bits up to its end
        passed = np.bitwise_count(((nth * LOWEST) | HIGHEST) - until & HIGHEST)  # bytes that end before it
        at = np.minimum(passed, 7).astype(np.uint64) * np.uint64(8)
        nth -= (until << np.uint64(8)) >> at & np.uint64(255)
        return word * 64 + at.astype(np.int64) + NTH_BIT[(held >> at & np.uint64(255)).astype(np.int64), np.minimum(nth, 7).astype(np.int64)]

    def zero(self, number: np.ndarray) -> np.ndarray:
        return self.bit(self.zeros, number, 0)

    def get(self, place: np.ndarray) -> np.ndarray:
        """The values at these places."""
        high = self.bit(64 * np.arange(len(self.zeros)) - self.zeros, place, 1) - place
        return (high << self.shift) | self.low[place].astype(np.int64)

    def find(self, wanted: np.ndarray) -> np.ndarray:
        """The place of each wanted value, or -1: successor search among those of its high bits."""
        out = np.full(len(wanted), -1, dtype=np.int64)
        if not self.size:
            return out
        wanted = wanted.astype(np.uint64)
        high = (wanted >> np.uint64(self.shift)).astype(np.int64)
        asked = np.flatnonzero(high < int(self.zeros[-1]))
        high, low = high[asked], (wanted[asked] & np.uint64((1 << self.shift) - 1)).astype(self.low.dtype)
        # neighbours often share their high bits, whose range is found once
        new = np.flatnonzero(np.concatenate([[True], high[1:] != high[:-1]])) if len(high) else high
        times, high = np.diff(new, append=len(high)), high[new]
        end = np.repeat(np.minimum(self.zero(high) - high, self.size), times)
        left = np.repeat(np.where(high > 0, self.zero(np.maximum(high - 1, 0)) - (high - 1), 0), times)
        right = end.copy()
        while (open_ := left < right).any():
            middle = (left + right) >> 1
            less = open_ & (self.low[np.minimum(middle, self.size - 1)] < low)
            right = np.where(open_ & ~less, middle, right)
            left = np.where(less, middle + 1, left)
        here = np.minimum(left, self.size - 1)
        out[asked] = np.where((left < end) & (self.low[here] == low), left, -1)
        return out

    def arrays(self) -> list[np.ndarray]:
        return [self.low, self.bits, self.zeros]


def mapped(sequences: list[EliasFano], codes: list[np.ndarray]) -> tuple[list[EliasFano], list[np.ndarray]]:
    """The same, read from a memory-mapped file that has no name and ends with its last reader."""
    arrays = [a for s in sequences for a in s.arrays()] + codes
    with tempfile.TemporaryFile() as file:
        places = []
        for a in arrays:
            places.append(file.seek(0, 2))
            file.write(np.ascontiguousarray(a).tobytes() + bytes(-a.nbytes % 8))
        file.flush()
        view = mmap.mmap(file.fileno(), max(1, file.tell()), access=mmap.ACCESS_READ) if file.tell() else b""
    back = [np.frombuffer(view, a.dtype, len(a), at) if len(a) else a for a, at in zip(arrays, places)]
    same = [EliasFano(s.size, s.shift, *back[3 * i : 3 * i + 3]) for i, s in enumerate(sequences)]
    return same, back[3 * len(sequences) :]


def levels(path: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Of sorted distinct grams (a column per word): each level's parents and children."""
    parents, children = [], []
    node = np.zeros(len(path), dtype=np.int64)
    for k in range(path.shape[1]):
        new = np.ones(len(path), dtype=bool)
        new[1:] = (node[1:] != node[:-1]) | (path[1:, k] != path[:-1, k])
        parents.append(node[new])
        children.append(path[new, k])
        node = np.cumsum(new) - 1
    return parents, children


class Trie:
    """Words, then one level per gram length, with quantised codes at chosen levels.

    ``grams`` holds sorted distinct rows of places in the sorted dictionary ``words``. The
    children of a node are numbers that rise by its base, where the base of
    each node is the total width of those before it: bases are the monotone pointers from one
    level to the next, and a child is found by a successor search for base + number, relative
    to its context.
    """

    def __init__(self, words: np.ndarray, grams: np.ndarray, codes: list[np.ndarray]):
        parents, children = levels(grams)
        built = [EliasFano.of(words)]
        nodes = 1
        for parent, child in zip(parents, children):
            width = np.zeros(nodes, dtype=np.int64)
            last = np.flatnonzero(np.concatenate([parent[1:] != parent[:-1], [True]]))[: len(parent)]
            width[parent[last]] = child[last] + 1  # children rise
            bases = np.concatenate([[0], np.cumsum(width)])
            built += [EliasFano.of(bases), EliasFano.of(bases[parent] + child)]
            nodes = len(child)
        (self.words, *self.levels), self.codes = mapped(built, codes)

    def numbers(self, words: np.ndarray) -> np.ndarray:
        """Dictionary numbers, -1 for words that no gram has."""
        return self.words.find(words)

    def children(self, level: int, parents: np.ndarray, owner: np.ndarray, numbers: np.ndarray) -> np.ndarray:
        """Nodes reached from ``parents[owner]`` by words of these numbers, -1 where there is none."""
        bases, ids = self.levels[2 * level], self.levels[2 * level + 1]
        out = np.full(len(numbers), -1, dtype=np.int64)
        real = parents >= 0
        first, end = np.zeros((2, len(parents)), dtype=np.int64)
        first[real], end[real] = bases.get(parents[real]), bases.get(parents[real] + 1)
        asked = np.flatnonzero((numbers >= 0) & (numbers < (end - first)[owner]))
        out[asked] = ids.find(first[owner[asked]] + numbers[asked])
        return out
