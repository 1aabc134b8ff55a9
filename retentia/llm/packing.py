"""Best-fit packing of tokenised documents by swap-based local search.

Documents are cut only if they are longer than a sequence.  The pieces are dealt
evenly into groups of bounded size; a group is packed by best fit and then
improved: documents move, are exchanged one for one, or two for one, between
underfull bins, whenever that raises the sum of squared fills, so the emptiest
bins drain until they vanish.  The few underfull bins left of many groups meet
in the next round and are searched again, until one group is left, so the whole
corpus loses about one partly filled bin, not one per group.

Defined results: a null or empty text is its end token alone; every row is a
document of its own, also if its doc_id is repeated or null; of equal choices
the earlier piece in (length, doc_id, piece) order is taken.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections.abc import Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import hold, release

CAPACITY = 4096
END_TOKEN = 1
#: Pieces of a group, groups that meet in the next round, and the underfull bins each of them sends there.
#: Other bins stay as they are: they are packed already, so nothing is left out.
GROUP, FAN_IN, SENT = 8192, 32, 48
#: Effort of the local search: donor bins that may get stuck one after the other, and exchanges in all.
DONORS, STEPS = 48, 4000
MEMO_WORDS, LONG_TEXT = 350_000, 1 << 21

_PIECES = "doc_id long, piece int, start long, length int, ids_crc32 long"


#: The split that the tokenizer file itself makes after lower-casing: fixed values of that file.
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


#: The last letter before the phonetic alphabet.
LAST_LATIN = "\u024f"


def _byte_letters() -> dict[int, int]:
    """The byte-level alphabet: printable Latin-1 bytes stand for themselves, the others for letters from 256 on."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(256, 512))
    return {b: b if b in printable else next(others) for b in range(256)}


class _Memory:
    """Two generations of a dictionary: when the young one is full it replaces the old one."""

    def __init__(self, most: int):
        self.most, self.young, self.old = most, {}, {}

    def missing(self, keys: set) -> list:
        """Keys that are not remembered; the others become young."""
        out = []
        for k in keys - self.young.keys():
            if (v := self.old.get(k)) is None:
                out.append(k)
            else:
                self.young[k] = v
        return out

    def age(self) -> None:
        if len(self.young) > self.most:
            self.young, self.old = {}, self.young


class WordIds:
    """Token ids of texts.  White space never joins tokens of this vocabulary, so words are encoded once and remembered.

    Latin words are split and lower-cased as the tokenizer does it, so that their parts are remembered too; words of
    other scripts, whose character classes differ between Unicode versions, and special tokens go to it as they are.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.split, self.merge, self.letters = regex.compile(_SPLIT), self.tokenizer.model.tokenize, _byte_letters()
        self.words, self.parts = _Memory(MEMO_WORDS), _Memory(MEMO_WORDS)

    def _encode(self, parts: list[str]) -> list[bytes]:
        """Ids as little-endian bytes.  Latin parts need the merges only; all others take the tokenizer's whole way."""
        out: list = [None] * len(parts)
        other = []
        for i, p in enumerate(parts):
            if p.isascii() and p.isalpha():  # letters that stand for themselves
                own = p
            elif "<|" in p or max(p) > LAST_LATIN:
                other.append(i)
                continue
            else:
                own = p.encode("utf-8").decode("latin-1").translate(self.letters)
            out[i] = array("I", [t.id for t in self.merge(own)]).tobytes()
        if other:
            for i, e in zip(other, self.tokenizer.encode_batch([parts[i] for i in other], add_special_tokens=False)):
                out[i] = array("I", e.ids).tobytes()
        return out

    def _parts(self, word: bytes) -> list[str]:
        text = word.decode("utf-8")
        if not text.isalpha() and "<|" in text or not text.isascii() and max(text) > LAST_LATIN:
            return [text]
        text = text.lower()
        if text.isalpha():
            return [text]
        if text[-1] in ".," and text[:-1].isalpha():
            return [text[:-1], text[-1]]
        return self.split.findall(text)

    def learn(self, words: set[bytes]) -> None:
        self.words.age()
        self.parts.age()
        new = self.words.missing(words)
        split = [self._parts(w) for w in new]
        unknown = self.parts.missing(set(chain.from_iterable(split)))
        self.parts.young.update(zip(unknown, self._encode(unknown)))
        known = self.parts.young
        young = self.words.young
        for w, s in zip(new, split):
            young[w] = known[s[0]] if len(s) == 1 else b"".join([known[p] for p in s])

    def batch(self, texts: list[str | None]) -> list[np.ndarray]:
        """The ids of each text."""
        words = [(t or "").encode("utf-8").split() for t in texts]
        self.learn(set(chain.from_iterable(words)))
        known = self.words.young
        return [np.frombuffer(b"".join(map(known.__getitem__, w)), "<u4") for w in words]

    def ids(self, text: str | None) -> np.ndarray:
        if len(text or "") <= LONG_TEXT:
            return self.batch([text])[0]
        words, parts = (m[0] for m in re.finditer(r"[^\x20\x09-\x0D]+", text)), []
        while some := list(islice(words, 100_000)):
            parts.append(self.batch([" ".join(some)])[0])
        return np.concatenate(parts) if parts else np.empty(0, np.uint32)

    def all(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """The ids of each text, about ``LONG_TEXT`` characters at a time."""
        group, size = [], 0
        for text in texts.to_pylist():
            if size + len(text or "") > LONG_TEXT and group:
                yield from self.batch(group)
                group, size = [], 0
            if len(text or "") > LONG_TEXT:
                yield self.ids(text)
                continue
            group.append(text)
            size += len(text or "")
        if group:
            yield from self.batch(group)


_LOADED: dict[str, WordIds] = {}


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]) of every document."""
    def run(batches):
        if path not in _LOADED:
            _LOADED[path] = WordIds(path)
        words = _LOADED[path]
        for batch in batches:
            rows: list[tuple] = []
            for doc_id, found in zip(batch.column(0), words.all(batch.column(1))):
                ids = np.append(found, np.uint32(END_TOKEN)).astype("<u4")
                for k, at in enumerate(range(0, len(ids), capacity)):
                    part = ids[at : at + capacity]
                    rows.append((doc_id.as_py(), k, at, len(part), zlib.crc32(part.tobytes()), part))
            columns = list(zip(*rows)) or [()] * 6
            arrays = [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64()))]
            if with_ids:
                arrays.append(pa.array([x.astype(np.int32) for x in columns[5]], pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids
    schema = _PIECES + ", ids array<int>" * with_ids
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)


def best_fit(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """Bin of each piece: longest first, each into the fullest bin that it fits."""
    room: list[list[int]] = [[] for _ in range(capacity + 1)]
    bins, some, out = 0, 0, np.zeros(len(lengths), np.int64)  # bit r of some: a bin has room r
    for i in np.argsort(-lengths, kind="stable").tolist():
        length = int(lengths[i])
        fitting = some >> length
        if fitting:
            r = length + (fitting & -fitting).bit_length() - 1
            b = room[r].pop()
            if not room[r]:
                some &= ~(1 << r)
        else:
            r, b, bins = capacity, bins, bins + 1
        out[i] = b
        if r > length:
            room[r - length].append(b)
            some |= 1 << (r - length)
    return out


def _largest_gain(given: np.ndarray, kept: np.ndarray, room: np.ndarray) -> tuple[int, int, int]:
    """(gain, i, j): exchanging given[i] for kept[j] fills the bin of kept[j] most, within its room."""
    gain = given[:, None] - kept[None, :]
    gain[gain > room[None, :]] = 0
    at = int(gain.argmax())
    i, j = divmod(at, len(kept))
    return int(gain[i, j]), i, j


def local_search(lengths: np.ndarray, bin_of: np.ndarray, capacity: int, donors: int = DONORS, steps: int = STEPS) -> np.ndarray:
    """Drain the emptiest bins: documents move, or are exchanged one for one, two for one or one for two.

    Every exchange fills a fuller bin and empties the emptiest, so the sum of squared fills grows and the search ends:
    when no exchange is left for the ``donors`` emptiest bins, after ``steps`` exchanges, or as soon as the number
    of bins is the smallest that the total length allows.
    """
    bin_of = bin_of.copy()
    fill = np.bincount(bin_of, lengths).astype(np.int64)
    live, lowest, stuck = int((fill > 0).sum()), -(-int(lengths.sum()) // capacity), set()
    while live > lowest and steps > 0 and len(stuck) < donors:
        low = next((b for b in np.argsort(fill, kind="stable").tolist() if 0 < fill[b] < capacity and b not in stuck), None)
        if low is None:
            break
        others = np.flatnonzero((bin_of != low) & (fill[bin_of] < capacity))
        others = others[np.argsort(bin_of[others], kind="stable")]
        open_bins = np.unique(bin_of[others])
        moved = False
        while steps > 0 and len(open_bins):
            steps -= 1
            mine = np.flatnonzero(bin_of == low)
            if not len(mine):
                live -= 1
                break
            size, room = lengths[mine], capacity - fill[open_bins]
            fits = np.flatnonzero(size <= room.max())
            give, take, to = [], [], -1
            if len(fits):  # the longest document that fits anywhere moves to the tightest place
                i = fits[size[fits].argmax()]
                to = int(open_bins[np.where(room >= size[i], room, capacity + 1).argmin()])
                give = [mine[i]]
            else:
                one = np.unique(size, return_index=True)[1][:64]
                kept, space = lengths[others], capacity - fill[bin_of[others]]
                gain, i, j = _largest_gain(size[one], kept, space)
                if gain > 0:
                    give, take = [mine[one[i]]], [others[j]]
                else:
                    first, second = np.triu_indices(min(len(mine), 24), 1)
                    if len(first):
                        gain, i, j = _largest_gain(size[first] + size[second], kept, space)
                    if gain > 0:
                        give, take = [mine[first[i]], mine[second[i]]], [others[j]]
                    else:
                        for apart in (1, 2, 3):  # two documents of one bin for one of the low bin
                            same = np.flatnonzero(bin_of[others[apart:]] == bin_of[others[:-apart]]) if len(others) > apart else []
                            if not len(same):
                                break
                            a, b = others[same], others[same + apart]
                            gain, i, j = _largest_gain(size[one], lengths[a] + lengths[b], capacity - fill[bin_of[a]])
                            if gain > 0:
                                give, take = [mine[one[i]]], [a[j], b[j]]
                                break
                if not give:
                    break
                to = int(bin_of[take[0]])
            moved = True
            grown = int(lengths[give].sum() - lengths[take].sum())
            bin_of[give], bin_of[take] = to, low
            fill[to] += grown
            fill[low] -= grown
            others = others[(bin_of[others] != low) & (fill[bin_of[others]] < capacity)]
            others = np.concatenate([others, np.array([g for g in give if fill[to] < capacity], np.int64)])
            open_bins = open_bins[fill[open_bins] < capacity]
        if moved:
            stuck.clear()
        if fill[low]:
            stuck.add(low)
    return bin_of


def _pack(capacity: int, level: int):
    """A function for applyInArrow: packs one group; at later levels the rows come with the bin that they are in."""
    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by([("length", "ascending"), ("doc_id", "ascending"), ("piece", "ascending"), ("row", "ascending")])
        lengths = t["length"].to_numpy().astype(np.int64)
        if level == 0:
            bin_of = best_fit(lengths, capacity)
        else:
            bin_of = np.unique(t["sequence_id"].to_numpy(), return_inverse=True)[1]
        bin_of = local_search(lengths, bin_of, capacity)
        order = np.argsort(bin_of, kind="stable")
        fill = np.bincount(bin_of, lengths).astype(np.int64)
        offset = np.empty(len(lengths), np.int64)
        ends = np.cumsum(lengths[order])
        first = np.searchsorted(bin_of[order], bin_of[order])  # where the bin's pieces begin
        offset[order] = ends - lengths[order] - (ends - lengths[order])[first]
        sequence = (level << 58) | (t["group"][0].as_py() << 24) | bin_of
        emptiest = np.empty(len(fill), np.int64)
        emptiest[np.argsort(np.where(fill > 0, fill, capacity), kind="stable")] = np.arange(len(fill))
        rank = np.where(fill < capacity, emptiest, 1 << 30)[bin_of]
        for name, values in (("sequence_id", sequence), ("offset", offset), ("rank", rank)):
            t = t.set_column(t.schema.get_field_index(name), name, pa.array(values, pa.int64()))
        return t

    return run


def pack(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``cut`` (as ``pieces`` makes it; no texts) with sequence_id and offset."""
    rows = hold(cut.withColumn("row", F.monotonically_increasing_id()))
    held = [rows]
    groups = max(1, -(-rows.count() // GROUP))
    extra = {"sequence_id": 0, "offset": 0, "rank": 0}
    work = rows.withColumns({k: F.lit(v).cast("long") for k, v in extra.items()})
    work = work.withColumn("group", F.pmod(F.xxhash64("row"), F.lit(groups)).cast("long"))
    done, level = [], 0
    while True:
        packed = hold(work.groupBy("group").applyInArrow(_pack(capacity, level), work.schema))
        held.append(packed)
        if groups == 1:
            done.append(packed)
            break
        done.append(packed.where(F.col("rank") >= SENT))
        groups = -(-groups // FAN_IN)
        work = packed.where(F.col("rank") < SENT).withColumn("group", F.floor(F.col("group") / FAN_IN))
        level += 1
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    release(rows)
    return out.drop("row", "group", "rank")


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids, doc_ids): the training sequences themselves, from pieces packed ``with_ids``."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "doc_id", "ids")))  # at most CAPACITY tokens
    grouped = packed.groupBy("sequence_id").agg(parts.alias("parts"))
    return grouped.select("sequence_id", F.flatten(F.col("parts.ids")).alias("ids"), F.col("parts.doc_id").alias("doc_ids"))
