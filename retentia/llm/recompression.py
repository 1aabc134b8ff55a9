"""Recompression of word sequences: rounds that name runs and pairs alike everywhere.

A round replaces every maximal run of one symbol by a symbol named after
(symbol, length), then every adjacent (left, right) pair by a symbol named
after the two.  Which symbols are left and which right is one bit of a hash of
the name, so pairs never overlap and the choice depends on the two names only.
Names are 64-bit hashes of what they stand for, hence globally consistent: the
same words get the same interior symbols in every document and every task.

Each symbol also carries the span of words it stands for and the *context*: the
smallest word range that fixes the symbol.  A symbol whose context lies inside a
repeated passage therefore occurs, with the same name, in every copy of it.
"""

from __future__ import annotations

import numpy as np

from .words import mix

_U = np.uint64


class Symbols:
    """One level: names with their spans [start, end) and contexts [low, high), all in word positions."""

    __slots__ = ("name", "start", "end", "low", "high")

    def __init__(self, name, start, end, low, high):
        self.name, self.start, self.end, self.low, self.high = name, start, end, low, high

    def take(self, keep):
        return Symbols(*(getattr(self, f)[keep] for f in self.__slots__))


def words_as_symbols(names: np.ndarray, offsets: np.ndarray) -> Symbols:
    """Level 0 of several documents; a barrier symbol of empty span (end = start) follows each document."""
    at = np.insert(np.arange(len(names)), offsets[1:], -1)
    wall = at < 0
    name = np.zeros(len(at), _U)
    name[~wall] = names
    at[wall] = offsets[1:]
    return Symbols(name, at, at + ~wall, at, at + ~wall)


def _barrier(s: Symbols) -> np.ndarray:
    return s.start == s.end


#: A context that no window holds: beside a document's edge the other copy may go on differently.
_FAR = 1 << 40


def runs(s: Symbols, level: int) -> Symbols:
    """Name every maximal run; a symbol's context grows by its two neighbours, which end the run."""
    n = len(s.name)
    if not n:
        return s
    wall = _barrier(s)
    new = np.ones(n, bool)
    new[1:] = (s.name[1:] != s.name[:-1]) | wall[1:] | wall[:-1]
    first = np.flatnonzero(new)
    last = np.append(first[1:], n) - 1
    length = last - first + 1
    name = s.name[first].copy()
    many = length > 1
    name[many] = mix(name[many] * _U(0x9E3779B97F4A7C15) + length[many].astype(_U) + _U(level + 1))
    low, high = np.minimum.reduceat(s.low, first), np.maximum.reduceat(s.high, first)
    free = ~wall[first]
    before, after = first - 1, last + 1
    edge_before = (before < 0) | wall[np.maximum(before, 0)]
    edge_after = (after >= n) | wall[np.minimum(after, n - 1)]
    low = np.where(free, np.where(edge_before, -_FAR, np.minimum(low, s.low[np.maximum(before, 0)])), low)
    high = np.where(free, np.where(edge_after, _FAR, np.maximum(high, s.high[np.minimum(after, n - 1)])), high)
    return Symbols(name, s.start[first], s.end[last], low, high)


def pairs(s: Symbols, level: int) -> Symbols:
    """Name every adjacent (left, right) pair; sides come from a hash bit of the name, new for each level."""
    n = len(s.name)
    if n < 2:
        return s
    wall = _barrier(s)
    right = (mix(s.name + _U((0xD1B54A32D192ED03 * (level + 1)) % 2**64)) >> _U(63)).astype(bool)
    join = np.zeros(n, bool)  # symbol i is joined with i + 1
    join[:-1] = ~right[:-1] & right[1:] & ~wall[:-1] & ~wall[1:]
    second = np.zeros(n, bool)
    second[1:] = join[:-1]
    low, high, end, name = s.low.copy(), s.high.copy(), s.end.copy(), s.name.copy()
    j = np.flatnonzero(join)
    name[j] = mix(s.name[j] * _U(0xA24BAED4963EE407) + mix(s.name[j + 1] + _U(level + 1)))
    end[j], low[j], high[j] = s.end[j + 1], np.minimum(s.low[j], s.low[j + 1]), np.maximum(s.high[j], s.high[j + 1])
    # A left symbol that stays alone is fixed by what follows it, a right one by what precedes it.
    alone = ~join & ~second & ~wall
    for at, beside in ((alone & ~right, 1), (alone & right, -1)):
        at = np.flatnonzero(at)
        to = np.clip(at + beside, 0, n - 1)
        edge = wall[to] | (to == at)
        low[at] = np.where(edge, -_FAR, np.minimum(s.low[at], s.low[to]))
        high[at] = np.where(edge, _FAR, np.maximum(s.high[at], s.high[to]))
    return Symbols(name, s.start, end, low, high).take(~second)


def levels(names: np.ndarray, offsets: np.ndarray, rounds: int) -> list[Symbols]:
    """Levels 0 to ``rounds``."""
    out = [words_as_symbols(names, offsets)]
    for r in range(rounds):
        out.append(pairs(runs(out[-1], r), r))
    return out


class Ranges:
    """Hash of the words of any range, from prefix sums of a polynomial modulo 2**64."""

    _R = 0x9E3779B97F4A7C15

    def __init__(self, names: np.ndarray, seed: int = 0):
        n = len(names)
        r = (self._R + 4 * seed) | 1
        self.down = np.cumprod(np.full(n + 1, pow(r, -1, 2**64), _U)) * _U(r)  # r ** -i
        up = np.cumprod(np.full(n + 1, r, _U)) * _U(pow(r, -1, 2**64))  # r ** i
        self.sums = np.zeros(n + 1, _U)
        np.cumsum(mix(names + _U(seed)) * up[:n], out=self.sums[1:])

    def hash(self, first: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[first]) * self.down[first] + (end - first).astype(_U))


def anchors(names: np.ndarray, offsets: np.ndarray, window: int, rounds: int = 2) -> np.ndarray:
    """For every word position p, the name of the symbol that stands for window [p, p + window).

    It is the widest symbol of the highest level that the window's own words fix
    (ties: the leftmost), together with the words of its context.  Equal windows
    therefore get equal anchors, and windows without such a symbol (one long
    run) fall back to a lower level, in the end to their first word.  Neighbouring
    windows mostly share their anchor, so there are far fewer anchors than windows.
    """
    n = len(names)
    out = mix(names + _U(1))
    todo = np.ones(n, bool)
    ranges = Ranges(names)
    for s in reversed(levels(names, offsets, rounds)[1:]):
        s = s.take((s.end > s.start) & (s.high - s.low <= window))
        span = s.end - s.start
        which = np.full(n, -1, np.int64)
        for width in np.unique(span):  # wider ones overwrite; within a width the leftmost is written last
            i = np.flatnonzero(span == width)[::-1]
            first = np.maximum(s.high[i] - window, 0)
            count = s.low[i] - first + 1
            shift = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            which[np.repeat(first, count) + shift] = np.repeat(i, count)
        got = todo & (which >= 0)
        if got.any():
            label = mix(s.name + ranges.hash(s.low, s.high))
            out[got] = label[which[got]]
            todo &= ~got
    return out
