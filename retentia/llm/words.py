"""Vectorised word hashing shared by the shingle and window operators.

A word is a maximal run of bytes other than space and \\x09-\\x0D.  Every word
gets a 64-bit name that depends on its bytes only, so equal words have equal
names in every task.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_PIECE = 1 << 16  # bytes hashed at once: bounds the temporary arrays


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * _M1
    x = x ^ (x >> np.uint64(27))
    x = x * _M2
    return x ^ (x >> np.uint64(31))


class WordHasher:
    """Names of the words of byte strings, from prefix sums of a polynomial of the bytes modulo 2**64."""

    _R = 0xD6E8FEB86659FD93

    def __init__(self, lower: bool = False):
        table = np.random.default_rng(1).integers(0, 2**64, 256, dtype=np.uint64)
        self.byte = table[_LOWER] if lower else table
        self._grow(_PIECE + 1024)

    def _grow(self, n: int) -> None:
        r, inverse = np.uint64(self._R), np.uint64(pow(self._R, -1, 2**64))
        self.up = np.cumprod(np.full(n, r))
        self.down = np.cumprod(np.full(n, inverse))

    def words(self, text: bytes) -> tuple[np.ndarray, np.ndarray]:
        """uint64 name and first byte of each word of ``text``, in order."""
        raw = np.frombuffer(text, np.uint8)
        if len(raw) > len(self.up):  # one very long word: the same powers continue
            self._grow(len(raw))
        edges = np.flatnonzero(np.diff(_SPACE[raw].view(np.int8), prepend=np.int8(1), append=np.int8(1)))
        starts, ends = edges[::2], edges[1::2]
        sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(self.byte[raw] * self.up[: len(raw)], out=sums[1:])
        return mix((sums[ends] - sums[starts]) * self.down[starts] + (ends - starts).astype(np.uint64)), starts

    def names(self, text: bytes) -> np.ndarray:
        return np.concatenate([self.words(p)[0] for p in _pieces(text)]) if text else np.empty(0, np.uint64)


def _pieces(text: bytes) -> Iterable[bytes]:
    """Cut a long text at white space into pieces of about ``_PIECE`` bytes."""
    at = 0
    while at < len(text):
        end = at + _PIECE
        while end < len(text) and not _SPACE[text[end]]:
            end += 1
        yield text[at:end]
        at = end


def batch_names(hasher: WordHasher, texts: list) -> tuple[np.ndarray, np.ndarray]:
    """Names of all words of ``texts`` (None: no words) and the offsets of each text: n + 1 entries.

    Texts are joined with a space, so one vectorised pass serves many short texts.
    """
    raw = [b"" if t is None else t if isinstance(t, bytes) else t.encode("utf-8", "surrogatepass") for t in texts]
    parts, counts = [np.empty(0, np.uint64)], np.zeros(len(raw) + 1, np.int64)
    group, size = [], 0

    def flush():
        if len(group) == 1 and size > _PIECE:
            names = hasher.names(raw[group[0]])
            counts[group[0] + 1] = len(names)
        elif group:
            names, starts = hasher.words(b" ".join([raw[i] for i in group]))
            ends = np.cumsum([len(raw[i]) + 1 for i in group])
            counts[np.array(group) + 1] = np.diff(np.searchsorted(starts, ends), prepend=0)
        else:
            return
        parts.append(names)

    for i, t in enumerate(raw):
        if size + len(t) > _PIECE:
            flush()
            group, size = [], 0
        group.append(i)
        size += len(t) + 1
    flush()
    return np.concatenate(parts), np.cumsum(counts)
