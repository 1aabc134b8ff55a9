"""Exact deduplication by skew-safe combining, with DataFrame operations only.

Equal texts are combined three times, and each time the whole normalised text is
part of the grouping key, so a digest collision can never join two texts:

1. locally: Spark's partial aggregation leaves one row per text and input split;
2. by (digest, salt): a group of copies, however large, spreads over ``SALTS`` groups;
3. globally by digest: at most ``SALTS`` winners per text are left by then.

The decision then travels back to the rows by (digest, salt), without the texts.

Defined results: a null text counts as empty; a null doc_id never wins against a
number and is its group's ``keep_id`` only if all are null; of rows that repeat a
doc_id in one group exactly one is kept.  Other columns may have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .frames import hold, plain_names

#: A group of copies is spread over this many groups before it is combined.
SALTS = 256
WHITE = r"[\x20\x09-\x0D]+"


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), WHITE, " ")


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def _spread() -> Column:
    return F.pmod(F.xxhash64("doc_id", "spread"), F.lit(SALTS)).cast("int")


def decisions(docs: DataFrame, digest=sha256) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, digest), one row per row of ``docs``.

    ``digest`` names texts; a weak one costs time but never changes a result.
    """
    base = docs.select("doc_id", normalised(F.col("text")).alias("norm"), F.octet_length("text").alias("spread"))
    keyed = base.select("doc_id", "norm", digest(F.col("norm")).alias("digest"), _spread().alias("salt"))
    rows = hold(keyed.select("doc_id", "digest", "salt", F.monotonically_increasing_id().alias("row")))
    salted = keyed.groupBy("digest", "salt", "norm").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("n"))
    texts = salted.groupBy("digest", "norm").agg(F.min("keep_id").alias("keep_id"), F.sum("n").alias("group_size"))
    winners = hold(texts.groupBy("digest").agg(
        F.count(F.lit(1)).alias("texts"), F.min("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size")))
    if winners.where("texts > 1").isEmpty():
        # Every digest stands for one text, as the full comparison above has shown.
        to_rows = rows.select("digest", "salt").distinct().join(winners.drop("texts"), "digest")
        found = rows.join(to_rows, ["digest", "salt"])
    else:  # texts that share a digest: the rows find their text itself
        by_text = salted.select("digest", "salt", "norm").join(texts, ["digest", "norm"])
        found = keyed.withColumn("row", F.monotonically_increasing_id()).join(by_text, ["digest", "salt", "norm"])
        found = hold(found.drop("norm"))
    # One row stays even if its doc_id is repeated in the group.
    same = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    firsts = (found.where(same).groupBy("digest", "group_size", "keep_id").agg(F.min("row").alias("row"))
              .select("row", F.lit(True).alias("kept")))
    return found.join(firsts, "row", "left").select(
        "doc_id", "keep_id", "group_size", F.coalesce("kept", F.lit(False)).alias("kept"), "digest")


def deduplicate(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns.

    The rows are shuffled once, by (doc_id, digest); of rows that repeat both, all but one are dropped before that.
    """
    def named(doc_id: Column) -> Column:  # a plain equality join then finds null ids too, by the same partitioning
        return F.coalesce(doc_id.cast("string"), F.lit("null"))

    kept = decisions(docs).where("kept").select(named(F.col("doc_id")).alias("name"), "digest")
    plain, new = plain_names(docs)
    text = F.col(new["text"])
    rows = plain.withColumns({"name": named(F.col(new["doc_id"])), "digest": sha256(normalised(text))})
    once = Window.partitionBy("name", "digest").orderBy(text)
    rows = rows.withColumn("nth", F.row_number().over(once)).where("nth = 1").drop("nth")
    return rows.join(kept, ["name", "digest"], "left_semi").drop("name", "digest").toDF(*docs.columns)
