"""Counting phrases in a HAT-trie: hash containers below a shallow trie of word ids.

A phrase is a run of 64-bit word ids, a column each; all phrases of a trie have as many words. A
container is an open-addressing hash table over the phrases whose next id lies in a range. One
that gets too full bursts: a range of several ids is halved, and a single id becomes a trie node
with a container for the ids that follow. When the trie holds too many phrases, whole subtrees of
the root are taken out as sorted runs, the largest first.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from .words import GOLDEN, mix

#: Phrases at which a container bursts, and keys that are inserted in one go.
BURST = 32_768
AT_ONCE = 32_768
LARGEST = (1 << 64) - 1

Keys = np.ndarray  # shape (words, phrases), uint64


def hashed(keys: Keys) -> np.ndarray:
    out = keys[0]
    with np.errstate(over="ignore"):
        for column in keys[1:]:
            out = mix(out * GOLDEN + column)
    return mix(out)


def in_order(keys: Keys) -> np.ndarray:
    return np.lexsort(keys[::-1])


class Container:
    """Phrases with the same first ``depth`` ids and the next one from ``low`` up, counted."""

    def __init__(self, depth: int, low: int, words: int, room: int = 1024):
        self.depth, self.low, self.words, self.size = depth, low, words, 0
        self.clear(room)

    def clear(self, room: int) -> None:
        self.keys = np.zeros((self.words, room), dtype=np.uint64)
        self.counts = np.zeros(room, dtype=np.int64)

    def add(self, keys: Keys, counts: np.ndarray) -> None:
        for at in range(0, keys.shape[1], AT_ONCE):
            part, numbers = keys[:, at : at + AT_ONCE], counts[at : at + AT_ONCE]
            room = len(self.counts)
            while room < 2 * (self.size + part.shape[1]):
                room *= 2
            if room > len(self.counts):
                old, held = self.entries()
                self.clear(room)
                self.insert(old, held)
            self.insert(part, numbers)
            self.size = int(np.count_nonzero(self.counts))

    def insert(self, keys: Keys, counts: np.ndarray) -> None:
        """Linear probing, all keys a step at a time."""
        mask = np.uint64(len(self.counts) - 1)
        slots, left = (hashed(keys) & mask).astype(np.int64), np.arange(keys.shape[1])
        while len(left):
            at = slots[left]
            free = self.counts[at] == 0
            # of the keys that see one free slot, the last one written claims it
            self.keys[:, at[free]] = keys[:, left[free]]
            same = (self.keys[:, at] == keys[:, left]).all(axis=0)
            np.add.at(self.counts, at[same], counts[left[same]])
            left = left[~same]
            slots[left] = (slots[left] + 1) & int(mask)

    def entries(self) -> tuple[Keys, np.ndarray]:
        held = self.counts > 0
        return self.keys[:, held], self.counts[held]

    def burst(self) -> list[Container | Node]:
        """What takes its place: two halves of its range, or a node for its only id."""
        keys, counts = self.entries()
        ids = keys[self.depth]
        if ids.min() == ids.max():
            node = Node(self.depth + 1, int(ids[0]), self.words)
            node.add(keys, counts)
            before = [Container(self.depth, self.low, self.words)] if node.low > self.low else []
            after = [Container(self.depth, node.low + 1, self.words)] if node.low < LARGEST else []
            return [*before, node, *after]
        middle = np.partition(ids, len(ids) // 2)[len(ids) // 2]
        middle = middle if middle > ids.min() else ids[ids > middle].min()
        halves = [Container(self.depth, low, self.words) for low in (self.low, int(middle))]
        for half, chosen in zip(halves, (ids < middle, ids >= middle)):
            half.add(keys[:, chosen], counts[chosen])
        return halves


class Node:
    """Children by ranges of the id at ``depth``; ``low``: the id before it (0 for the root)."""

    def __init__(self, depth: int, low: int, words: int):
        self.depth, self.low, self.words = depth, low, words
        self.children: list[Container | Node] = [Container(depth, 0, words)]

    @property
    def size(self) -> int:
        return sum(child.size for child in self.children)

    def add(self, keys: Keys, counts: np.ndarray) -> None:
        if keys.shape[1] == 0:
            return
        lows = np.array([child.low for child in self.children], dtype=np.uint64)
        owner = np.searchsorted(lows, keys[self.depth], side="right") - 1
        order = np.argsort(owner, kind="stable")
        ends = np.cumsum(np.bincount(owner, minlength=len(lows)))
        children = []
        for child, start, end in zip(self.children, [0, *ends[:-1]], ends):
            children += filled(child, keys[:, order[start:end]], counts[order[start:end]])
        self.children = children

    def entries(self) -> tuple[Keys, np.ndarray]:
        parts = [child.entries() for child in self.children]
        return np.concatenate([k for k, _ in parts], axis=1), np.concatenate([c for _, c in parts])


def filled(child: Container | Node, keys: Keys, counts: np.ndarray) -> list[Container | Node]:
    """The child, or what it bursts into, with more phrases; a burst container takes the rest piecewise."""
    if isinstance(child, Node):
        child.add(keys, counts)
        return [child]
    for at in range(0, keys.shape[1], AT_ONCE):
        child.add(keys[:, at : at + AT_ONCE], counts[at : at + AT_ONCE])
        if child.size > BURST:
            parts = Node(child.depth, child.low, child.words)
            parts.children = child.burst()
            parts.add(keys[:, at + AT_ONCE :], counts[at + AT_ONCE :])
            return parts.children
    return [child]


class HatTrie:
    """Counts phrases of ``size`` words; sorted runs of (keys, counts) come out when it is full, and at its end."""

    def __init__(self, size: int, most: int = 1_000_000):
        self.most, self.root = most, Node(0, 0, size)

    def add(self, keys: Keys) -> Iterator[tuple[Keys, np.ndarray]]:
        for at in range(0, keys.shape[1], self.most // 4):
            part = keys[:, at : at + self.most // 4]
            self.root.add(part, np.ones(part.shape[1], dtype=np.int64))
            if self.root.size > self.most:
                yield from self.spill(self.most // 2)

    def spill(self, leave: int) -> Iterator[tuple[Keys, np.ndarray]]:
        """Runs of whole subtrees, the largest first, until at most ``leave`` phrases are left."""
        held = self.root.size
        for place in sorted(range(len(self.root.children)), key=lambda i: -self.root.children[i].size):
            child = self.root.children[place]
            if held <= leave or not child.size:
                return
            held -= child.size
            keys, counts = child.entries()
            order = in_order(keys)
            yield keys[:, order], counts[order]
            self.root.children[place] = Container(0, child.low, self.root.words)

    def rest(self) -> Iterator[tuple[Keys, np.ndarray]]:
        return self.spill(0)
