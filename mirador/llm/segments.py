"""Cutting texts where no token of a byte-level BPE pattern can cross: between a character
that is not white space and white space, and before a last full stop or comma. A segment is tokenised by itself, and only once
while a worker remembers it."""

from __future__ import annotations

import re
from collections.abc import Callable
from itertools import accumulate, chain, repeat

import numpy as np

#: Unicode White_Space (fixed values).
WHITE = "\t-\r \x85\xa0  -     　"
GENERAL = re.compile(f"[{WHITE}]*[^{WHITE}]+|[{WHITE}]+")
UNSAFE = re.compile(r"\s ")
ENDS = (".", ",")
#: Characters of a segment that is not remembered for later batches.
LONG = 1000


def segments(text: str) -> list[str]:
    """The text in pieces; joined they are the text."""
    if not text:
        return []
    if UNSAFE.search(text):
        return GENERAL.findall(text)
    first, *rest = text.split(" ")
    out = [first] if first else []
    for part in rest:
        if part[-1:] in ENDS and part[-2:-1].isalnum():  # a mark after a letter or digit is a token of its own
            out += (" " + part[:-1], part[-1])
        else:
            out.append(" " + part)
    return out


class Memory:
    """Token ids of segments, encoded on first sight.

    ``encode`` takes new segments and returns their id counts and all ids in a row. Beyond
    ``most`` segments, or ``most_chars`` characters of them, those that were met only once are
    forgotten, as are long ones. ``spells`` keeps the decimal ids of each segment as a text, too.
    """

    def __init__(
        self,
        encode: Callable[[list[str]], tuple[np.ndarray, np.ndarray]],
        most: int = 500_000,
        most_chars: int = 16 << 20,
        spells: bool = False,
    ):
        self.encode, self.most, self.most_chars, self.spells = encode, most, most_chars, spells
        self.places: dict[str, int] = {}
        self.spelled: list[str] = []
        self.sizes = np.zeros(0, dtype=np.int64)
        self.counts = np.zeros(0, dtype=np.int64)
        self.starts = np.zeros(0, dtype=np.int64)
        self.ids = np.zeros(0, dtype=np.int32)
        self.met = np.zeros(0, dtype=np.int64)

    def forget(self) -> None:
        kept = (self.met > 1) & (self.sizes <= LONG)
        while kept.sum() > self.most // 2 or self.sizes[kept].sum() > self.most_chars // 2:  # too many to keep them all
            kept &= self.met > np.median(self.met[kept])
        old = np.flatnonzero(kept)
        self.spelled = [self.spelled[k] for k in old] if self.spells else []
        self.sizes = self.sizes[old]
        ids = self.tokens(old)
        place = np.cumsum(kept) - 1
        self.places = {s: int(place[p]) for s, p in self.places.items() if kept[p]}
        self.counts, self.met, self.ids = self.counts[old], self.met[old] // 2, ids
        self.starts = np.cumsum(self.counts) - self.counts

    def learn(self, new: list[str]) -> None:
        counts, ids = self.encode(new)
        base = len(self.places)
        self.places.update(zip(new, range(base, base + len(new))))
        self.starts = np.concatenate([self.starts, len(self.ids) + np.cumsum(counts) - counts])
        self.counts = np.concatenate([self.counts, counts])
        self.ids = np.concatenate([self.ids, ids])
        self.met = np.concatenate([self.met, np.zeros(len(new), dtype=np.int64)])
        self.sizes = np.concatenate([self.sizes, np.fromiter(map(len, new), np.int64, len(new))])
        if self.spells:
            texts, ends = list(map(str, ids.tolist())), np.cumsum(counts).tolist()
            self.spelled += [",".join(texts[a:b]) for a, b in zip([0, *ends], ends)]

    def find(self, every: list[str], times: np.ndarray | None = None) -> np.ndarray:
        """Places of segments, after new ones are encoded; ``times`` says how often each was met."""
        if len(self.places) > self.most or self.sizes.sum() > self.most_chars:
            self.forget()
        at = np.fromiter(map(self.places.get, every, repeat(-1)), np.int64, len(every))
        unseen = np.flatnonzero(at < 0)
        if len(unseen):
            wanted = [every[k] for k in unseen]
            self.learn(list(dict.fromkeys(wanted)))
            at[unseen] = list(map(self.places.__getitem__, wanted))
        self.met += np.bincount(at, times, minlength=len(self.met)).astype(np.int64)
        return at

    def places_of(self, found: list[list[str]]) -> list[np.ndarray]:
        """Places of the segments of each text, after new segments are encoded."""
        at = self.find(list(chain.from_iterable(found)))
        ends = list(accumulate(map(len, found)))
        return [at[a:b] for a, b in zip([0, *ends], ends)]

    def tokens(self, places: np.ndarray) -> np.ndarray:
        counts = self.counts[places]
        ends = np.cumsum(counts)
        total = int(ends[-1]) if len(ends) else 0
        return self.ids[np.arange(total) + np.repeat(self.starts[places] - ends + counts, counts)]
