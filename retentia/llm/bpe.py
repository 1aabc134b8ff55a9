"""Byte-level BPE encoding and decoding by prefix dynamic programming.

For every byte prefix of a piece of text the encoding has one possible last
token: the token t that ends there, such that the prefix before t ends in a
token that may stand next to t (encoding the bytes of the two gives the two
back).  Storing that last token for each prefix makes encoding linear, appends
exact, and an edit costs only the bytes until the stored tokens agree again.

Defined results: a null or empty text has no tokens; every other text is split
by the pattern and each match encoded on its own; decoding gives the bytes back.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from itertools import chain, islice

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

#: Pieces up to this many bytes are remembered, at most twice so many of them.
MEMO_BYTES, MEMO_PIECES, MEMO_PAIRS = 64, 200_000, 500_000
#: Texts of more characters are encoded in steps, so their pieces are never all in memory.
LONG_TEXT, STEP = 1 << 20, 100_000


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class Vocabulary:
    def __init__(self, ranks: dict[bytes, int]):
        if any(bytes([b]) not in ranks for b in range(256)):
            raise ValueError("a byte-level vocabulary must hold all 256 bytes")
        self.ranks = ranks
        self.bytes_of = [b""] * (max(ranks.values()) + 1)
        for token, i in ranks.items():
            self.bytes_of[i] = token
        self.decimal = [str(i) for i in range(len(self.bytes_of))]
        self.longest = max(map(len, ranks))
        self._beside: dict[int, bool] = {}
        self.sizes = list(map(len, self.bytes_of))
        self.automaton = ahocorasick.Automaton()
        for token, i in ranks.items():
            if self.merge(token) == [i]:  # a token that merging cannot produce never ends a prefix
                self.automaton.add_word(token.decode("latin-1"), i)
        self.automaton.make_automaton()

    def merge(self, data: bytes) -> list[int]:
        """Encoding by the definition: join the lowest-ranked neighbours, leftmost first.  For short strings."""
        rank, none = self.ranks.get, 1 << 60
        parts = [data[i : i + 1] for i in range(len(data))]
        joined = [rank(a + b, none) for a, b in zip(parts, parts[1:])]
        while joined and (least := min(joined)) < none:
            i = joined.index(least)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del joined[i]
            if i < len(joined):
                joined[i] = rank(parts[i] + parts[i + 1], none)
            if i:
                joined[i - 1] = rank(parts[i - 1] + parts[i], none)
        return [self.ranks[p] for p in parts]

    def beside(self, left: int, right: int) -> bool:
        """Whether an encoding may hold the two tokens next to each other."""
        key = left << 32 | right
        ok = self._beside.get(key)
        if ok is None:
            if len(self._beside) >= MEMO_PAIRS:
                self._beside.clear()
            ok = self._beside[key] = self.merge(self.bytes_of[left] + self.bytes_of[right]) == [left, right]
        return ok

    def extend(self, data: bytes, last: list[int], upto: int) -> None:
        """Add the last tokens of the prefixes of ``data`` up to ``upto`` bytes: the longest token that may end there."""
        first = max(0, len(last) - self.longest + 1)
        sizes, beside = self.sizes, self.beside
        # The automaton gives the tokens that end at each byte, longest first.
        for at, token in self.automaton.iter(data[first:upto].decode("latin-1")):
            at += first
            if at == len(last):
                start = at + 1 - sizes[token]
                if not start or beside(last[start - 1], token):
                    last.append(token)


class Prefixes:
    """A piece of bytes and, for each of its prefixes, the last token of that prefix's encoding."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b""):
        self.vocabulary, self.data, self.last = vocabulary, b"", []
        self.append(data)

    def append(self, more: bytes) -> None:
        """Exact: the stored tokens of the prefixes so far stay as they are."""
        self.data += more
        self.vocabulary.extend(self.data, self.last, len(self.data))

    def replace(self, start: int, end: int, new: bytes) -> int:
        """Exchange bytes [start, end); returns how many prefixes were computed anew."""
        data = self.data[:start] + new + self.data[end:]
        last, shift, agree = self.last[:start], len(new) - (end - start), 0
        for at in range(start + 1, len(data) + 1):
            self.vocabulary.extend(data, last, at)
            old = at - shift
            # A prefix depends on the `longest` prefixes before it; once those agree, so does all the rest.
            agree = agree + 1 if at > start + len(new) and old >= 1 and last[-1] == self.last[old - 1] else 0
            if agree >= self.vocabulary.longest:
                last += self.last[old:]
                self.data, self.last = data, last
                return at - start
        self.data, self.last = data, last
        return len(data) - start

    def tokens(self) -> list[int]:
        out, end = [], len(self.data)
        while end:
            out.append(self.last[end - 1])
            end -= len(self.vocabulary.bytes_of[out[-1]])
        return out[::-1]


class Encoder(dict):
    """Piece -> its token ids; a memory of the short pieces met so far, in two generations."""

    def __init__(self, vocabulary: Vocabulary, pattern: str):
        self.pattern = regex.compile(pattern)
        self.vocabulary = vocabulary
        self.old: dict[str, tuple[int, ...]] = {}

    def __missing__(self, piece: str) -> tuple[int, ...]:
        ids = self.old.get(piece)
        if ids is not None:
            self[piece] = ids
            return ids
        data = piece.encode("utf-8")
        whole = self.vocabulary.ranks.get(data)  # a piece that is a token is that token
        ids = (whole,) if whole is not None else tuple(Prefixes(self.vocabulary, data).tokens())
        if len(data) <= MEMO_BYTES:
            if len(self) >= MEMO_PIECES:
                self.old = dict(self)
                self.clear()
            self[piece] = ids
        return ids

    def steps(self, text: str | None) -> Iterator[list[int]]:
        """The ids of a text, in one list, or in several if the text is long."""
        if not text:
            return
        if len(text) <= LONG_TEXT:
            yield list(chain.from_iterable(map(self.__getitem__, self.pattern.findall(text))))
            return
        found = self.pattern.finditer(text)
        while part := list(islice(found, STEP)):
            yield list(chain.from_iterable(self[m[0]] for m in part))

    def encode(self, text: str | None) -> list[int]:
        return list(chain.from_iterable(self.steps(text)))

    def decode(self, ids) -> bytes:
        return b"".join(map(self.vocabulary.bytes_of.__getitem__, ids))


_LOADED: dict[tuple[str, str], Encoder] = {}


def encoder(path: str, pattern: str) -> Encoder:
    """One encoder per Python worker."""
    if (path, pattern) not in _LOADED:
        _LOADED[path, pattern] = Encoder(Vocabulary(load_ranks(path)), pattern)
    return _LOADED[path, pattern]


def _mapped(df: DataFrame, column: str, added: str, make, keep: list[str]) -> DataFrame:
    """Columns ``keep`` and Arrow columns that ``make`` computes from one column, batch by batch; added names win."""
    new = [a.split()[0] for a in added.split(", ")]
    rest = [c for c in keep if c not in new]
    names = [f"c{i}" for i in range(len(rest))] + new

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], *make(batch.column(0))], names=names)

    plain = df.select(df[column].alias("v"), *[df[c].alias(f"c{i}") for i, c in enumerate(rest)])
    kinds = dict(df.dtypes)
    schema = ", ".join([f"c{i} {kinds[c]}" for i, c in enumerate(rest)] + [added])
    return plain.mapInArrow(run, schema).toDF(*rest, *new)


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text") -> DataFrame:
    """``docs`` with their token ids in ``ids``."""
    def make(values):
        e = encoder(path, pattern)
        return [pa.array([e.encode(v.as_py()) for v in values], pa.list_(pa.int32()))]

    return _mapped(docs, text, "ids array<int>", make, docs.columns)


def decode(encoded: DataFrame, path: str, pattern: str, ids: str = "ids") -> DataFrame:
    """``encoded`` with the bytes that the ids stand for in ``decoded``."""
    def make(values):
        e = encoder(path, pattern)
        return [pa.array([e.decode(v.as_py() or ()) for v in values], pa.binary())]

    return _mapped(encoded, ids, "decoded binary", make, encoded.columns)


def digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): encode, decode the ids, and keep digests of both."""
    def make(values):
        e = encoder(path, pattern)
        out = [], [], []
        for v in values:
            n, ids_hash, text_hash = 0, hashlib.sha256(), hashlib.sha256()
            for ids in e.steps(v.as_py()):
                ids_hash.update((" " * bool(n) + " ".join(map(e.vocabulary.decimal.__getitem__, ids))).encode())
                text_hash.update(e.decode(ids))
                n += len(ids)
            for column, x in zip(out, (n, ids_hash.hexdigest(), text_hash.hexdigest())):
                column.append(x)
        return [pa.array(out[0], pa.int64()), pa.array(out[1]), pa.array(out[2])]

    return _mapped(docs, "text", "n_tokens long, ids_sha256 string, decoded_sha256 string", make, ["doc_id"])
