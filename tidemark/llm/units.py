"""Cutting texts at spaces, and a worker's bounded cache of what an encoder makes of the units between them."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np

#: White space that a byte-level pattern may join across a cut at a space.
JOINED = re.compile(r"\s (?:\s|\Z)")
#: Entries of a cache; characters of the longest unit that stays in it; characters of texts that are handled together.
CACHE, LONG, TOGETHER = 800_000, 96, 6_000_000
#: Hashes that a RecurringCache tells apart; a power of two.
MARKS = 1 << 20


def cut(text: str) -> list[str] | None:
    """The units of a text (the first has no leading space), or None where cuts at spaces could change the result."""
    if "<|" in text or JOINED.search(text):
        return None
    return text.split(" ")


def together(texts: list[str], most: int = TOGETHER) -> Iterator[list[str]]:
    """Runs of texts of about ``most`` characters."""
    run, size = [], 0
    for x in texts:
        run.append(x)
        size += len(x)
        if size >= most:
            yield run
            run, size = [], 0
    if run:
        yield run


class UnitCache(dict):
    """unit -> value. fill() encodes at once all units that are missing; long ones leave again with the next fill()."""

    def __init__(self, encode: Callable[[list[str]], Iterable], base: dict | None = None, most: int = CACHE):
        super().__init__(base or {})
        self.encode, self.base, self.most, self.long = encode, base or {}, most, []

    def fill(self, units: set[str]) -> None:
        for u in self.long:
            self.pop(u, None)
        missing = [u for u in units if u not in self]
        if len(self) + len(missing) > self.most + len(self.base):
            self.clear()
            self.update(self.base)
            missing = [u for u in units if u not in self]
        self.update(zip(missing, self.encode(missing), strict=True))
        self.long = [u for u in missing if len(u) > LONG]


class RecurringCache(dict):
    """unit -> value, as UnitCache, for few entries: a unit stays once it has come in two fills.

    Units that come once, most of all, would drive out those that come again. Which have come is noted in a table of
    ``MARKS`` bytes by their hash. At half of ``most`` entries the cache becomes the older half, of which what is asked for
    again moves to the younger one. A unit that is wrongly in or out is only encoded once more or kept in vain.
    """

    def __init__(self, encode: Callable[[list[str]], Iterable], most: int):
        super().__init__()
        self.encode, self.most, self.older, self.once = encode, most, {}, []
        self.marks, self.marked = bytearray(MARKS), 0

    def fill(self, units: set[str]) -> None:
        for u in self.once:
            self.pop(u, None)
        if 2 * len(self) > self.most:
            self.older = dict(self)
            self.clear()
        if 4 * self.marked > MARKS:
            self.marks, self.marked = bytearray(MARKS), 0
        missing, self.once = [], []
        for u in units - self.keys():
            if u in self.older:
                self[u] = self.older[u]
                continue
            missing.append(u)
            at = hash(u) & MARKS - 1
            if len(u) > LONG or not self.marks[at]:
                self.once.append(u)
                self.marked += not self.marks[at]
                self.marks[at] = 1
        self.update(zip(missing, self.encode(missing), strict=True))


def split_by_offsets(starts: np.ndarray, lengths: list[int]) -> np.ndarray:
    """For joined strings of these lengths: how many of the sorted offsets ``starts`` lie in each."""
    ends = np.cumsum(np.asarray(lengths, np.int64))
    return np.diff(np.searchsorted(starts, ends, "left"), prepend=0)
