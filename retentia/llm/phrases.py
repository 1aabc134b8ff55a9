"""Phrase collocations by dynamic itemset counting.

The corpus is written once as blocks of numbered words, dealt into ``SHARDS``
shards, which are scanned cyclically, one per step.  Words are counted from the
first step on.  A longer phrase becomes active in the step after both phrases
that lack its last or its first word have reached the threshold, wherever the
scan then stands, and is counted for one full cycle of shards; so lengths
interleave, and the scan ends when no phrase is active.

A step is one job: tasks count the active phrases of the shard's blocks, and one
aggregation by (phrase, language), kept as one string, adds them to the phrases
under way.  A phrase's row carries the shards already in its count (bits), the
step in which its cycle ends and the step in which it reached the threshold; rows
that end their cycle below the threshold go.  Which phrases are active, tasks
read from a table of fixed size (``2 ** TABLE_BITS`` bytes, broadcast): at two
hashed places of a phrase, the last step in which a phrase of that place reached
the threshold, so the table may let a phrase in too early or too long, never the
reverse.  The shard bits keep such a phrase's count right, so results are exact
and whole.

Defined results: a null text has no words; a null lang is ``und``; phrases never
cross the marks that part pieces.  Repeated rows count each time.  Other columns
may have any name and are not read.  A piece must fit into a task's memory; long
texts are cut between pieces.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import staging_path
from .frames import hold, release
from .words import mix

LONGEST = 4
THRESHOLD = 30
SHARDS = 4
BLOCK_BYTES = 4 << 20
TABLE_BITS = 24
#: Rows that ask for the count of one phrase are spread over this many groups.
SALTS = 64

#: Lists of numbers travel as bytes; words, which hold no line break, as lines.
_BLOCK = "shard int, words string, langs binary, hashes binary, ids binary, lang_names array<string>, lang_words array<long>"
_COUNTED = "phrase string, c long, until int"

#: Lower case, blanks to spaces, marks between pieces to line breaks.
_LETTERS = bytes(c + 32 if 65 <= c <= 90 else 32 if c == 9 else 10 if c in b".,;:!?\n\x0b\x0c\r" else c for c in range(256))
_U = np.uint64
_NEXT = _U(0x9E3779B97F4A7C15)


def word_hash(lang: str, word: str) -> int:
    return xxhash.xxh3_64_intdigest(f"{lang}\0{word}")


def extend(h: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Hash of a phrase and one more word."""
    return mix(h * _NEXT + word)


def distinct(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(position of the first of each distinct value, number of the distinct value at each position)."""
    codes = pa.array(key).dictionary_encode().indices.to_numpy()
    first = np.empty(int(codes.max()) + 1 if len(codes) else 0, np.int64)
    first[codes[::-1]] = np.arange(len(codes) - 1, -1, -1)
    return first, codes


def places(h: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    return (h >> _U(64 - bits)).astype(np.int64), (h & _U((1 << bits) - 1)).astype(np.int64)


def _cut(text: bytes) -> Iterator[bytes]:
    """A long text in parts of about a block, cut between pieces."""
    at = 0
    while at < len(text):
        end = len(text)
        if end - at > BLOCK_BYTES:
            end = text.rfind(b"\n", at, at + BLOCK_BYTES) + 1 or text.find(b"\n", at + BLOCK_BYTES) + 1 or end
        yield text[at:end]
        at = end


def block(langs: list[str], texts: list[bytes]) -> dict:
    """Distinct words, and the texts as word numbers from 1 with 0 between pieces."""
    names = sorted(set(langs))
    code = {n: i for i, n in enumerate(names)}
    raw = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    ends_of_texts = np.cumsum([len(t) + 1 for t in texts])
    blank = (raw == 32) | (raw == 10)
    edges = np.flatnonzero(np.diff(blank.view(np.int8), prepend=np.int8(1)))
    starts, ends = edges[::2], edges[1::2]
    offsets = np.zeros(len(starts) + 1, np.int32)
    np.cumsum(ends - starts, out=offsets[1:])
    words = pa.Array.from_buffers(pa.string(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(raw[~blank])]).dictionary_encode()
    codes = np.array([code[n] for n in langs])[np.searchsorted(ends_of_texts, starts, "right")]
    v = max(1, len(words.dictionary))
    key = codes * v + words.indices.to_numpy()
    first, ids = distinct(key)
    own = key[first]
    piece = np.cumsum(raw == 10, dtype=np.int32)[starts]
    ids = np.insert(ids.astype(np.int32) + 1, np.flatnonzero(np.diff(piece)) + 1, 0)
    word_list, langs = words.dictionary.take(pa.array(own % v)).to_pylist(), (own // v).astype(np.int32)
    hashes = np.array([word_hash(names[a], w) for a, w in zip(langs.tolist(), word_list)], _U)
    return {"words": "\n".join(word_list), "langs": langs.tobytes(), "hashes": hashes.tobytes(), "ids": ids.astype(np.int32).tobytes(),
            "lang_names": names, "lang_words": np.bincount(codes, minlength=len(names)).tolist()}


def _blocks(shards: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, langs, texts, size = TaskContext.get().partitionId(), [], [], 0

        def made():
            return pa.RecordBatch.from_pylist([{"shard": number % shards, **block(langs, texts)}], schema=schema)

        schema = pa.schema([("shard", pa.int32()), ("words", pa.string()), ("langs", pa.binary()), ("hashes", pa.binary()), ("ids", pa.binary()),
                            ("lang_names", pa.list_(pa.string())), ("lang_words", pa.list_(pa.int64()))])

        for b in batches:
            for lang, text in zip(b.column("lang").to_pylist(), b.column("text").cast(pa.binary()).to_pylist()):
                for cut in _cut(text.translate(_LETTERS)):
                    langs.append(lang)
                    texts.append(cut)
                    size += len(cut) + 1
                    if size >= BLOCK_BYTES:
                        yield made()
                        number, langs, texts, size = number + 1, [], [], 0
        if texts:
            yield made()

    return run


def numbered(docs: DataFrame, shards: int) -> str:
    """Write the blocks, a folder for each shard, and return where."""
    path = staging_path(docs.sparkSession, "phrases/blocks")
    texts = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    texts.mapInArrow(_blocks(shards), _BLOCK).write.partitionBy("shard").option("compression", "zstd").parquet(path)
    return path


def active(ids: np.ndarray, hashes: np.ndarray, table: np.ndarray, step: int, shards: int, longest: int):
    """(length, positions, last step) of the occurrences of active phrases in a block."""
    bits = len(table).bit_length() - 1

    def probe(h):
        a, b = places(h, bits)
        return np.minimum(table[a], table[b])

    h1 = np.concatenate([np.zeros(1, _U), hashes])[ids]
    h, t = h1, np.concatenate([np.zeros(1, table.dtype), probe(hashes)])[ids]  # of the phrases that start at each word
    for n in range(2, longest + 1):
        both = (t[:-1] > 0) & (t[1:] > 0)
        reached = np.where(both, np.maximum(t[:-1], t[1:]), 0).astype(np.int32)  # step + 1, 0: not yet
        at = np.flatnonzero((reached > 0) & (reached + shards > step))
        yield n, at, reached[at] - 1 + shards
        h = extend(h[:-1], h1[n - 1:])
        t = np.zeros(len(h), table.dtype)
        t[both] = probe(h[both])


def counted(words: pa.Array, last: pa.Array, ids: np.ndarray, n: int, at: np.ndarray, until: np.ndarray) -> pa.RecordBatch:
    """The distinct phrases of ``n`` words that start at ``at``, each with its number; ``last``: words as a phrase ends with them."""
    base = len(words) + 1
    key = ids[at].astype(np.int64)
    for k in range(1, n):
        if k > 1:
            key = distinct(key)[1].astype(np.int64)
        key = key * base + ids[at + k]
    first, codes = distinct(key)
    c = np.bincount(codes, minlength=len(first))
    chosen = at[first]
    parts = [(words if k < n - 1 else last).take(pa.array(ids[chosen + k] - 1)) for k in range(n)]
    phrase = parts[0] if n == 1 else pc.binary_join_element_wise(*parts, " ")
    return pa.RecordBatch.from_arrays([phrase, pa.array(c, pa.int64()), pa.array(until[first].astype(np.int32))], names=["phrase", "c", "until"])


def _counts(table, step: int, shards: int, longest: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = np.frombuffer(table.value, np.uint8)
        for b in batches:
            for i in range(b.num_rows):
                row = {c: b.column(c)[i].as_py() for c in b.schema.names}
                words, ids, hashes = pa.array(row["words"].split("\n")), np.frombuffer(row["ids"], np.int32), np.frombuffer(row["hashes"], _U)
                langs = pa.array(row["lang_names"], pa.string()).take(pa.array(np.frombuffer(row["langs"], np.int32)))
                # Words hold no tab: it parts the phrase and its language, which together are the name of a row.
                ends = pc.binary_join_element_wise(words, langs, "\t")
                if step < shards:
                    at = np.flatnonzero(ids)
                    yield counted(words, ends, ids, 1, at, np.full(len(at), shards - 1))
                for n, at, until in active(ids, hashes, known, step, shards, longest):
                    if len(at):
                        yield counted(words, ends, ids, n, at, until)

    return run


def _marks(bits: int):
    """Places of phrases in the table as (group of 64 places, bits)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = []
            for row in b.column("phrase").to_pylist():
                phrase, lang = row.split("\t", 1)
                first, *more = [np.array([word_hash(lang, w)], _U) for w in phrase.split(" ")]
                for w in more:
                    first = extend(first, w)
                found.append(first)
            at = np.unique(np.concatenate(places(np.concatenate(found or [np.zeros(0, _U)]), bits)))
            yield pa.RecordBatch.from_arrays([pa.array(at // 64), pa.array((_U(1) << (at % 64).astype(_U)).view(np.int64))], names=["at", "bits"])

    return run


def _mark(table: np.ndarray, reached: DataFrame, step: int) -> bool:
    """Note in the table that phrases reached the threshold; at most one row per 64 places comes to the driver."""
    bits = len(table).bit_length() - 1
    rows = reached.select("phrase").mapInArrow(_marks(bits), "at long, bits long").groupBy("at").agg(F.bit_or("bits").alias("bits")).toArrow()
    at, mask = rows["at"].to_numpy(), rows["bits"].to_numpy().view(_U)
    for k in range(64):
        table[at[mask >> _U(k) & _U(1) == 1] * 64 + k] = step + 1
    return len(at) > 0


def frequent(path: str, spark, shards: int, threshold: int = THRESHOLD, longest: int = LONGEST) -> DataFrame:
    """(lang, phrase, words, f) of all phrases of up to ``longest`` words that occur ``threshold`` times or more."""
    if not 0 < shards * longest < 255 or shards > 32:
        raise ValueError("steps are noted in one byte, shards in 32 bits")
    blocks = spark.read.schema(_BLOCK).parquet(path)
    table = np.zeros(1 << TABLE_BITS, np.uint8)
    zero, alone = F.lit(0).cast("long"), F.expr("substring_index(phrase, '\t', 1)")
    words = F.length(alone) - F.length(F.replace(alone, F.lit(" "), F.lit(""))) + 1
    state, step, last = None, 0, -1
    while step < shards or step <= last + shards:
        shared = spark.sparkContext.broadcast(table.tobytes())
        rows = blocks.where(F.col("shard") == step % shards).select("words", "langs", "hashes", "ids", "lang_names")
        # info: the step after the one that reached the threshold (0: none), then the bits of the counted shards.
        new = rows.mapInArrow(_counts(shared, step, shards, longest), _COUNTED).withColumns({"f": zero, "info": zero})
        both = new if state is None else new.unionByName(state.withColumn("c", zero))
        merged = both.groupBy("phrase").agg(F.sum("c").alias("c"), F.sum("f").alias("f"), F.max("info").alias("info"), F.max("until").alias("until"))
        bit = F.lit(1 << (step % shards)).cast("long")
        merged = merged.withColumn("f", F.col("f") + F.when(F.col("info").bitwiseAND(bit) == 0, F.col("c")).otherwise(0))
        info = F.when(F.col("c") > 0, F.col("info").bitwiseOR(bit)).otherwise(F.col("info"))
        reaches = (F.col("f") >= threshold) & (F.shiftright("info", 32) == 0)
        info = F.when(reaches, info.bitwiseOR(F.lit((step + 1) << 32).cast("long"))).otherwise(info)
        merged = merged.select("phrase", "f", info.alias("info"), "until").where((F.col("f") >= threshold) | (F.col("until") > step))
        # Almost every phrase is a value of its own: a dictionary of them would only cost time.
        before, state = state, hold(merged, **{"compression": "snappy", "parquet.enable.dictionary": "false"})
        if before is not None:
            release(before)
        shared.destroy()
        if _mark(table, state.where((F.shiftright("info", 32) == step + 1) & (words < longest)), step):
            last = step
        step += 1
    lang = F.expr("substring(phrase, instr(phrase, '\t') + 1)")
    return hold(state.where(F.col("f") >= threshold).select(lang.alias("lang"), alone.alias("phrase"), words.alias("words"), "f"))


def _cuts(candidates: DataFrame) -> DataFrame:
    """The two parts of every cut of a candidate, as rows (..., k, side, part)."""
    cut = candidates.withColumn("k", F.explode(F.expr("sequence(1, words - 1)")))
    cut = cut.withColumn("left", F.expr("substring_index(phrase, ' ', k)"))
    right = F.expr("substring(phrase, length(left) + 2)")
    sides = F.array(F.struct(F.lit("l").alias("side"), F.col("left").alias("part")), F.struct(F.lit("r").alias("side"), right.alias("part")))
    return cut.withColumn("both", F.explode(sides)).select("lang", "phrase", "words", "a", "k", "both.side", "both.part")


def scored(known: DataFrame) -> DataFrame:
    """(lang, phrase, words, a, k, l, r, score) of the frequent phrases of two words or more that no longer one explains."""
    candidates = known.where("words > 1").withColumnRenamed("f", "a")
    longer = known.where("words > 2").select(
        "lang", "f", F.explode(F.array(F.expr("substring_index(phrase, ' ', words - 1)"), F.expr("substring(phrase, instr(phrase, ' ') + 1)"))).alias("phrase"))
    # A phrase inside a much longer one is also inside one that is a word longer, and that occurs at least as often.
    most = longer.groupBy("lang", "phrase").agg(F.max("f").alias("inside"))
    left = candidates.join(most, ["lang", "phrase"], "left").where("inside IS NULL OR 100 * inside < 80 * a").drop("inside")
    asks = _cuts(left).withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    found = asks.select("lang", "part", "salt").distinct().join(known.select("lang", F.col("phrase").alias("part"), "f"), ["lang", "part"])
    cuts = asks.join(found, ["lang", "part", "salt"]).groupBy("lang", "phrase", "words", "a", "k").agg(
        F.sum(F.when(F.col("side") == "l", F.col("f"))).alias("l"), F.sum(F.when(F.col("side") == "r", F.col("f"))).alias("r"))
    cuts = cuts.withColumn("score", F.expr("(cast(a AS decimal(19, 0)) * 2000000) div (cast(l AS decimal(19, 0)) + r)"))
    lowest = cuts.groupBy("lang", "phrase", "words", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    return lowest.select("lang", "phrase", "words", "a", "cut.*")


def collocations(docs: DataFrame, top: int = 2000, threshold: int = THRESHOLD, longest: int = LONGEST) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each lang's first ``top`` phrases."""
    spark, shards = docs.sparkSession, SHARDS
    path = numbered(docs, shards)
    sizes = spark.read.schema(_BLOCK).parquet(path).select(F.explode(F.arrays_zip("lang_names", "lang_words")).alias("x"))
    sizes = sizes.groupBy(F.col("x.lang_names").alias("lang")).agg(F.sum("x.lang_words").alias("n"))
    found = scored(frequent(path, spark, shards, threshold, longest))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.join(sizes, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
