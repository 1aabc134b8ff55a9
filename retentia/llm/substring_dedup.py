"""Substring deduplication by recompression.

A window is ``WINDOW`` consecutive words.  A word goes if it lies in a window
that also starts in a document with a smaller doc_id.

1. Documents are dealt into blocks of about ``BLOCK_BYTES``.  Rounds of
   recompression name runs and pairs of words alike everywhere; every window is
   represented by the highest symbol that its words fix (see ``recompression``).
   Per block, each symbol is sent once, however often the block holds it.
2. Symbols that two blocks share reveal the windows that can be repeated across
   blocks; only those windows are sent, by a 128-bit hash of their words, and
   compared.  Equal windows have equal symbols, so none is missed.
3. Each block learns which of its windows start in a smaller document of another
   block, finds repeats between its own documents itself, and removes the words.

A passage in very many documents is one row per block, never one per document.
Texts are shuffled once by block; the three steps share that shuffle.

Defined results: a null text has no words; windows are judged on the input;
equal doc_ids do not remove each other; a null doc_id counts as larger than all
others.  A text without repeats is returned unchanged, another as its kept words
joined by one space.  Columns of any name are kept.  A document must fit into a task's memory.
"""

from __future__ import annotations

import hashlib
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import pieces, plain_names
from .recompression import Ranges, anchors
from .words import WordHasher, batch_names

WINDOW = 13
BLOCK_BYTES = 4 << 20
#: Words looked at together in a task.
STEP_WORDS = 60_000

_U = np.uint64
_NO_ID = np.iinfo(np.int64).max


def _steps(texts: pa.ChunkedArray, window: int):
    """(first document, names, offsets, positions at which windows start) for runs of documents of a block."""
    names, ends = batch_names(WordHasher(), texts.to_pylist())
    at, n = 0, len(ends) - 1
    while at < n:
        to = min(n, max(at + 1, int(np.searchsorted(ends, ends[at] + STEP_WORDS))))
        part, offsets = names[ends[at] : ends[to]], ends[at : to + 1] - ends[at]
        left = np.repeat(offsets[1:], np.diff(offsets)) - np.arange(len(part))
        yield at, part, offsets, np.flatnonzero(left >= window)
        at = to


def _hashes(names: np.ndarray, starts: np.ndarray, window: int):
    return [Ranges(names, seed).hash(starts, starts + window) for seed in (1, 2)]


def _ids(t: pa.Table, name: str) -> np.ndarray:
    return t[name].fill_null(_NO_ID).to_numpy().astype(np.int64)


def _document(offsets: np.ndarray, starts: np.ndarray) -> np.ndarray:
    return np.searchsorted(offsets, starts, "right") - 1


def _sent(block: int, buckets: int, key: np.ndarray, *columns: np.ndarray) -> pa.Table:
    """Rows (bucket, block, columns as bytes) of values sorted by ``key``; a bucket is a range of keys."""
    bucket = ((key >> _U(32)) * _U(buckets)) >> _U(32)
    cuts = np.flatnonzero(np.diff(bucket)) + 1
    firsts = np.concatenate([[0], cuts]) if len(key) else np.empty(0, np.int64)
    lasts = np.append(cuts, len(key)) if len(key) else firsts
    arrays = [pa.array(bucket[firsts].astype(np.int64), pa.int64()), pa.array(np.full(len(firsts), block), pa.int64())]
    arrays += [pa.array([c[a:b].tobytes() for a, b in zip(firsts, lasts)], pa.binary()) for c in columns]
    return pa.table(arrays, names=["bucket", "block", *(f"v{i}" for i in range(len(columns)))])


def _unpack(t: pa.Table, name: str, kind=np.uint64) -> tuple[np.ndarray, np.ndarray]:
    """All values of a bytes column, and the block of each."""
    parts = [np.frombuffer(x, kind) for x in t[name].to_pylist()]
    values = np.concatenate(parts) if parts else np.empty(0, kind)
    return values, np.repeat(t["block"].to_numpy(), [len(p) for p in parts]) if parts else np.empty(0, np.int64)


def _by_block(blocks: np.ndarray, values: np.ndarray) -> pa.Table:
    order = np.argsort(blocks, kind="stable")
    blocks, values = blocks[order], values[order]
    firsts = np.flatnonzero(np.diff(blocks, prepend=-1)) if len(blocks) else np.empty(0, np.int64)
    parts = np.split(values, firsts[1:]) if len(firsts) else []
    return pa.table([pa.array(blocks[firsts], pa.int64()), pa.array([p.tobytes() for p in parts], pa.binary())], names=["block", "found"])


def _among(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    if not len(known):
        return np.zeros(len(values), bool)
    at = np.minimum(np.searchsorted(known, values), len(known) - 1)
    return known[at] == values


def _known(t: pa.Table) -> np.ndarray:
    parts = [np.frombuffer(x, _U) for x in t["found"].to_pylist()]
    return np.unique(np.concatenate(parts)) if parts else np.empty(0, _U)


def _first_documents(h1: np.ndarray, h2: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of equal (h1, h2): the order that brings them together, and the smallest doc for each row in that order."""
    order = np.lexsort((h2, h1))
    new = np.ones(len(order), bool)
    new[1:] = (h1[order][1:] != h1[order][:-1]) | (h2[order][1:] != h2[order][:-1])
    firsts = np.flatnonzero(new)
    least = np.minimum.reduceat(doc[order], firsts) if len(firsts) else doc[:0]
    return order, least[np.cumsum(new) - 1] if len(firsts) else least


def _windows(t: pa.Table, doc_id: str, text: str, window: int, wanted: np.ndarray | None):
    """(h1, h2, doc_id, document, start) of the block's windows; only those whose symbol is in ``wanted``, if given."""
    ids, out = _ids(t, doc_id), []
    for first, names, offsets, starts in _steps(t[text], window):
        if wanted is not None and len(starts):
            starts = starts[_among(anchors(names, offsets, window)[starts], wanted)]
        if len(starts):
            document = _document(offsets, starts)
            out.append((*_hashes(names, starts, window), ids[first + document], first + document, starts - offsets[document]))
    empty = [np.empty(0, _U)] * 2 + [np.empty(0, np.int64)] * 3
    return [np.concatenate(c) for c in zip(*out)] if out else empty


def _among_pairs(h1: np.ndarray, h2: np.ndarray, known: pa.Table) -> np.ndarray:
    """Which (h1, h2) are among the pairs of ``known``."""
    parts = [np.frombuffer(x, _U).reshape(-1, 2) for x in known["found"].to_pylist()]
    k1, k2 = np.concatenate(parts).T if parts else np.empty((2, 0), _U)
    out = _among(h1, np.unique(k1))
    at = np.flatnonzero(out)
    order, least = _first_documents(np.concatenate([k1, h1[at]]), np.concatenate([k2, h2[at]]), np.repeat([0, 1], [len(k1), len(at)]))
    mine = order >= len(k1)
    out[at[order[mine] - len(k1)]] = least[mine] == 0
    return out


def added_names(docs: DataFrame) -> list[str]:
    """The names of the columns that ``remove_repeats`` adds: n_words, n_removed, kept_sha256, each after underscores if ``docs`` has it."""
    out = []
    for name in ("n_words", "n_removed", "kept_sha256"):
        while name.lower() in {c.lower() for c in docs.columns}:
            name = "_" + name
        out.append(name)
    return out


def remove_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` with the kept text in ``text``, all its other columns, and the columns of ``added_names``.

    These are the number of words, of words removed, and the digest of the kept words joined by one space.
    """
    added = added_names(docs)
    plain, new = plain_names(docs)
    doc_id, text = new["doc_id"], new["text"]
    blocks = pieces(docs, "text", BLOCK_BYTES)
    dealt = plain.withColumn("block", F.pmod(F.xxhash64(doc_id, text), F.lit(blocks)))
    columns = plain.columns

    def symbols(t: pa.Table) -> pa.Table:
        found = [anchors(names, offsets, window)[starts] for _, names, offsets, starts in _steps(t[text], window) if len(starts)]
        names = np.unique(np.concatenate(found)) if found else np.empty(0, _U)
        return _sent(t["block"][0].as_py(), blocks, names, names)

    def shared(t: pa.Table) -> pa.Table:
        names, block = _unpack(t, "v0")  # a block sends a symbol once
        order = np.argsort(names, kind="stable")
        names, block = names[order], block[order]
        same = names[1:] == names[:-1]
        twice = np.append(same, False) | np.insert(same, 0, False)
        return _by_block(block[twice], names[twice])

    def suspects(t: pa.Table, s: pa.Table) -> pa.Table:
        none = np.empty(0, _U)
        if not t.num_rows or not s.num_rows:
            return _sent(0, blocks, none, none, none, none.view(np.int64))
        h1, h2, ids, _, _ = _windows(t, doc_id, text, window, _known(s))
        order, least = _first_documents(h1, h2, ids)
        h1, h2 = h1[order], h2[order]
        once = np.ones(len(h1), bool)
        once[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
        return _sent(t["block"][0].as_py(), blocks, h1[once], h1[once], h2[once], least[once])

    def later(t: pa.Table) -> pa.Table:
        (h1, block), (h2, _), (ids, _) = _unpack(t, "v0"), _unpack(t, "v1"), _unpack(t, "v2", np.int64)
        order, least = _first_documents(h1, h2, ids)
        after = ids[order] > least  # the block's first document with the window is not the first of all
        return _by_block(block[order][after], np.column_stack([h1[order][after], h2[order][after]]))

    def cleaned(t: pa.Table, s: pa.Table) -> pa.Table:
        if not t.num_rows:
            return pa.table({n: pa.array([], f.type) for n, f in zip(names_out, schema_of(t))})
        h1, h2, ids, document, start = _windows(t, doc_id, text, window, None)
        gone = _among_pairs(h1, h2, s)
        order, least = _first_documents(h1, h2, ids)
        gone[order] |= ids[order] > least
        where, at = document[gone], start[gone]
        cuts = np.searchsorted(where, np.arange(t.num_rows + 1))  # documents come in order
        texts, counts, removed, digests = [], [], [], []
        for i, value in enumerate(t[text].to_pylist()):
            words = value.encode("utf-8").split() if value else []
            mine = at[cuts[i] : cuts[i + 1]]
            kept = words
            if len(mine):
                change = np.bincount(mine, minlength=len(words) + 1) - np.bincount(mine + window, minlength=len(words) + 1)
                kept = list(compress(words, (np.cumsum(change)[: len(words)] == 0).tolist()))
            joined = b" ".join(kept)
            texts.append(joined.decode("utf-8") if len(mine) else value)
            counts.append(len(words))
            removed.append(len(words) - len(kept))
            digests.append(hashlib.sha256(joined).hexdigest())
        out = [pa.array(texts, pa.string()) if c == text else t[c] for c in columns]
        return pa.table([*out, pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(digests)], names=names_out)

    names_out = [*columns, "n_words", "n_removed", "kept_sha256"]  # the others are called c0, c1, ... here

    def schema_of(t: pa.Table):
        return [t.schema.field(c) for c in columns] + [pa.field("n", pa.int64()), pa.field("n", pa.int64()), pa.field("n", pa.string())]

    known = "block long, found binary"
    first = dealt.groupBy("block").applyInArrow(symbols, "bucket long, block long, v0 binary")
    both = first.groupBy("bucket").applyInArrow(shared, known)
    asked = dealt.groupBy("block").cogroup(both.groupBy("block")).applyInArrow(
        suspects, "bucket long, block long, v0 binary, v1 binary, v2 binary")
    repeated = asked.groupBy("bucket").applyInArrow(later, known)
    kinds = ", ".join(f"{new[c]} {t}" for c, t in docs.dtypes)
    out = dealt.groupBy("block").cogroup(repeated.groupBy("block")).applyInArrow(
        cleaned, f"{kinds}, n_words long, n_removed long, kept_sha256 string")
    return out.toDF(*docs.columns, *added)
