"""Token counts with a digest cache.

A count depends on the text and on the tokenizer alone, so it is stored under two
digests: of the normalised content and of the tokenizer's version (library, its
version, the bytes of its file).  A run

1. digests every row and elects one row of each distinct text whose digest the cache lacks (an anti join of digests);
2. fetches the texts of the elected rows only and encodes each of them once;
3. appends the new counts to the cache, one committed write per run;
4. joins the rows with the cache by digest.

Rows travel as digests; a text is shuffled at most once, by (digest, doc_id), so
a group of copies, however large, is spread like any other rows.  In step 4 a
digest meets its rows by (digest, salt).  A run that dies before its append
leaves the cache as it was; two runs that append the same digest store the same
number, and readers take one.

Normalisation is null -> empty: any other folding would change counts of these
vocabularies.  Special strings inside texts are handled as the library does by
default; no tokens are added; nothing is truncated or padded.

Defined results: one row per row of ``docs``, also for repeated or null doc_ids; a
null or empty text has 0 bytes and the count of the empty text.  Other columns may
have any name and are not read.  A text must fit into a task's memory.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache
from importlib.metadata import version as library_version

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .frames import hold

#: Rows of one digest are spread over this many groups when they fetch their count.
SALTS = 256
#: Texts that the library encodes in one call: at most so many bytes together, or one text.
CALL_BYTES = 4 << 20

#: Parts of texts whose counts a task remembers.
MEMO = 500_000
_PLAIN = re.compile("[\t\n\r -~\u00c0-\u024f]*")
#: The pre-tokenizer meant here, and the split that it makes: fixed values of the file and the library.
_BYTE_LEVEL = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
_SPLIT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")

_CACHE = "digest binary, n_tokens long, version string"


class Tokenizer:
    """Counts of texts by the library that a vocabulary file belongs to.

    Byte-level vocabularies that split a text before they merge are given each distinct part once; its count is
    remembered.  That holds for texts of plain letters only, on whose classes all versions of Unicode agree, and without
    special tokens; the library itself splits all others.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.known, self.special = None, ()
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            self._encode = lambda texts: model.encode(texts, num_threads=1)
        else:
            import tokenizers

            model = tokenizers.Tokenizer.from_file(path)
            model.no_truncation()
            model.no_padding()
            self._encode = lambda texts: model.encode_batch_fast(texts, add_special_tokens=False)
            made = json.loads(model.to_str())
            if made["normalizer"] is None and made["pre_tokenizer"] == _BYTE_LEVEL:
                self.known, self.special = {}, [t["content"] for t in made["added_tokens"]]

    def counts(self, texts: list[str]) -> list[int]:
        if self.known is None:
            return self._counts(texts)
        out, others = [0] * len(texts), []
        for i, t in enumerate(texts):
            if len(t) <= CALL_BYTES and _PLAIN.fullmatch(t) and not any(s in t for s in self.special):
                parts = _SPLIT.findall(t)
                if new := [p for p in set(parts) if p not in self.known]:
                    if len(self.known) > MEMO:
                        self.known, new = {}, [*set(parts)]
                    self.known.update(zip(new, self._counts(new)))
                out[i] = sum(map(self.known.__getitem__, parts))
            else:
                others.append(i)
        for i, n in zip(others, self._counts([texts[i] for i in others])):
            out[i] = n
        return out

    def _counts(self, texts: list[str]) -> list[int]:
        out, group, size = [], [], 0
        for t in texts:
            if group and size + len(t) > CALL_BYTES:
                out += map(len, self._encode(group))
                group, size = [], 0
            group.append(t)
            size += len(t)
        return out + [len(x) for x in self._encode(group)] if group else out


@lru_cache(maxsize=4)
def _tokenizer(path: str) -> Tokenizer:
    return Tokenizer(path)  # the tasks of a Python worker share what it remembers


def tokenizer_version(path: str) -> str:
    """Digest of all that a count depends on besides the text."""
    library = "sentencepiece" if path.endswith(".model") else "tokenizers"
    with open(path, "rb") as f:
        return hashlib.sha256(f"{library} {library_version(library)}\n".encode() + f.read()).hexdigest()


def normalised(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def _named(doc_id: Column) -> Column:  # a plain equality join then finds null ids too
    return F.coalesce(doc_id.cast("string"), F.lit("null"))


def stored(spark: SparkSession, cache: str, version: str) -> DataFrame:
    """(digest, n_tokens) of one tokenizer version; empty before the first append."""
    path = spark._jvm.org.apache.hadoop.fs.Path(cache)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], _CACHE).drop("version")
    return spark.read.schema(_CACHE).parquet(cache).where(F.col("version") == version).drop("version")


def encoded(texts: DataFrame, path: str) -> DataFrame:
    """(digest, n_tokens) of rows (digest, text)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _tokenizer(path)
        for b in batches:
            n = tokenizer.counts(b.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([b.column("digest"), pa.array(n, pa.int64())], names=["digest", "n_tokens"])

    return texts.select("digest", "text").mapInArrow(run, "digest binary, n_tokens long")


def count(docs: DataFrame, path: str, cache: str, limit: int = 1024) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit), one row per row of ``docs``; ``cache`` is a folder that all executors share."""
    spark, version = docs.sparkSession, tokenizer_version(path)
    text = normalised(F.col("text"))
    keyed = docs.select("doc_id", text.alias("text"), F.unhex(F.sha2(text, 256)).alias("digest"))
    light = keyed.select("doc_id", "digest", F.octet_length("text").cast("long").alias("n_bytes"))
    rows = hold(light.withColumn("salt", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(SALTS)).cast("int")))

    elected = rows.groupBy("digest").agg(F.min("doc_id").alias("doc_id"))
    misses = elected.join(stored(spark, cache, version), "digest", "left_anti").select("digest", _named(F.col("doc_id")).alias("name"))
    own = keyed.select("digest", _named(F.col("doc_id")).alias("name"), "text").join(misses, ["digest", "name"], "left_semi")
    texts = own.distinct()  # rows that repeat an id and a text are one
    new = encoded(texts, path).withColumn("version", F.lit(version))
    new.write.mode("append").option("compression", "zstd").partitionBy("version").parquet(cache)

    known = stored(spark, cache, version).groupBy("digest").agg(F.min("n_tokens").alias("n_tokens"))
    by_salt = rows.select("digest", "salt").distinct().join(known, "digest")
    return rows.join(by_salt, ["digest", "salt"]).select(
        "doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
