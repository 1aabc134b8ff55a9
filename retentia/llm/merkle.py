"""Merkle manifest of a dataset: one tree per source, one tree over the sources.

A leaf is the digest of a row's fields; runs of ``ARITY`` consecutive nodes become
their parent until one node is left.  Every level is a table of nodes (tree,
place, size of the level in that tree, digest).  It is joined with itself on
computed sibling places (``place XOR 1`` for binary trees, slot offsets
otherwise); the rows of slot zero, which then know their whole run, emit the
parents.  All trees grow in the same joins, so a level is one job however many
sources there are, and a source with a third of all rows is only a longer tree:
the join keys are (tree, place).

Proofs travel back down: a node's path is its own siblings followed by its
parent's path, one join per level, so a row receives about ``ARITY - 1`` digests
a level and no row meets its source's key.

Leaves get their places by range partitions and counts per (partition, source);
no source is sorted in one task.

Defined results: null fields are ``-``; within a source rows ascend by doc_id (null
first), rows that repeat a doc_id by their leaf digest, and equal leaves are
interchangeable.  No rows make no tree.  A null text has no line breaks to lose.
Other columns may have any name and are not read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .frames import hold, release

ARITY = 3
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

_PATH = "array<struct<left:array<binary>,right:array<binary>>>"


def field(c: Column) -> Column:
    """``-`` if null, else byte count, ``:``, value."""
    s = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))


def digest(parts: Column) -> Column:
    return F.unhex(F.sha2(parts, 256))


def hexed(c: Column) -> Column:
    return F.lower(F.hex(c))


def _run(digests: Column) -> Column:
    """The text of consecutive digests."""
    return F.array_join(F.transform(digests, hexed), "")


def leaves(docs: DataFrame, tampered: Column | None = None) -> DataFrame:
    """(doc_id, tree, leaf, other) of each row; ``other`` is the leaf with the text ``tampered``, null where that is null."""
    def leaf(text: Column) -> Column:
        return digest(F.concat(*[field(text if c == "text" else F.col(c)) for c in FIELDS]))

    other = F.lit(None).cast("binary") if tampered is None else F.when(tampered.isNotNull(), leaf(tampered))
    return docs.select("doc_id", field(F.col("source")).alias("tree"), leaf(F.col("text")).alias("leaf"), other.alias("other"))


def placed(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` (a held table with ``tree``) with ``place``, from 0 in each tree by ``order``, and the tree's ``size``."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Equal rows would all fall into one range: a spread value parts them.
    spread = rows.withColumn("spread", F.xxhash64(F.monotonically_increasing_id()))
    ranged = hold(spread.repartitionByRange(n, "tree", *order, "spread").withColumn("part", F.spark_partition_id()))
    counts = ranged.groupBy("tree", "part").agg(F.count(F.lit(1)).alias("n"))
    # One row per (tree, range): a tree's rows here are at most as many as there are ranges.
    parts = Window.partitionBy("tree")
    before = F.coalesce(F.sum("n").over(parts.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("tree", "part", before.alias("start"), F.sum("n").over(parts).alias("size"))
    inside = F.row_number().over(Window.partitionBy("part", "tree").orderBy(*order, "spread")) - 1
    return (ranged.withColumn("nth", inside).join(starts, ["tree", "part"])
            .withColumn("place", F.col("start") + F.col("nth")).drop("part", "spread", "nth", "start"))


def _sibling(place: Column, arity: int, nth: int) -> Column:
    """The place of the ``nth`` sibling, counted from the left without the node itself."""
    if arity == 2:
        return place.bitwiseXOR(F.lit(1).cast("long"))
    slot = F.pmod(place, F.lit(arity))
    return place - slot + F.when(slot > nth, nth).otherwise(nth + 1)


def with_siblings(nodes: DataFrame, arity: int) -> DataFrame:
    """Nodes with ``left`` and ``right``, the digests of the other nodes of their run, by one equijoin per sibling."""
    out = nodes
    for k in range(arity - 1):
        out = out.withColumn("at", _sibling(F.col("place"), arity, k))
        sibling = nodes.select("tree", F.col("place").alias("at"), F.col("digest").alias(f"s{k}"))
        out = out.join(sibling, ["tree", "at"], "left").drop("at")
    slot = F.pmod("place", F.lit(arity))
    found = F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"s{k}").alias("digest")) for k in range(arity - 1)])
    found = F.filter(found, lambda x: x["digest"].isNotNull())

    def side(keep) -> Column:
        return F.transform(F.filter(found, keep), lambda x: x["digest"])

    return out.withColumns({"left": side(lambda x: x["k"] < slot), "right": side(lambda x: x["k"] >= slot)}).drop(
        *[f"s{k}" for k in range(arity - 1)])


def levels(nodes: DataFrame, arity: int = ARITY) -> list[DataFrame]:
    """All levels of all trees from the held leaves (tree, place, size, digest), each with its siblings and written once.

    A tree's root is its node in a level of size 1.
    """
    out = []
    while True:
        level = hold(with_siblings(nodes, arity))
        out.append(level)
        parents = level.where((F.col("size") > 1) & (F.pmod("place", F.lit(arity)) == 0))
        if parents.isEmpty():
            return out
        nodes = parents.select("tree", F.expr(f"place div {arity}").alias("place"), F.expr(f"(size + {arity - 1}) div {arity}").alias("size"),
                               digest(F.concat(hexed(F.col("digest")), _run(F.col("right")))).alias("digest"))


def roots(tree_levels: list[DataFrame]) -> DataFrame:
    """(tree, digest) of every tree."""
    found = [x.where("size = 1").select("tree", "digest") for x in tree_levels]
    return reduce(DataFrame.unionByName, found)


def paths(tree_levels: list[DataFrame], above: DataFrame, arity: int = ARITY) -> DataFrame:
    """(tree, place, path, *more) of every leaf: its siblings level by level, then what ``above`` (tree, path, *more) continues with."""
    more = [c for c in above.columns if c not in ("tree", "path")]
    own = F.array(F.struct("left", "right"))
    found = None
    for level in reversed(tree_levels):  # written level by level: plans stay small however many levels there are
        here = level.where("size = 1").select("tree", "place").join(above, "tree")
        if found is not None:
            up = found.select("tree", F.col("place").alias("up"), F.col("path").alias("rest"), *more)
            below = level.where("size > 1").withColumn("up", F.expr(f"place div {arity}")).join(up, ["tree", "up"])
            here = here.unionByName(below.select("tree", "place", F.concat(own, "rest").alias("path"), *more))
        before, found = found, hold(here)
        if before is not None:
            release(before, level)
    return found


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its path lead to."""
    return F.aggregate(path, leaf, lambda acc, step: digest(F.concat(_run(step["left"]), hexed(acc), _run(step["right"]))))


def proof(path: Column) -> Column:
    """Digest of all siblings of a path, left to right, level by level."""
    return digest(F.array_join(F.transform(path, lambda step: F.concat(_run(step["left"]), _run(step["right"]))), ""))


def manifest(docs: DataFrame, tampered: Column | None = None, arity: int = ARITY) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof, folded_root, verified) per row, digests as bytes.

    ``folded_root`` is recomputed with the siblings of the original from the leaf, or, where the text ``tampered`` is not null,
    from that text's leaf.
    """
    rows = hold(leaves(docs, tampered))
    leaf_rows = hold(placed(rows, ["doc_id", "leaf"]))
    nodes = leaf_rows.select("tree", "place", "size", F.col("leaf").alias("digest"))
    by_source = levels(nodes, arity)
    # The sources are the leaves of one more tree, in the order of their names, null first.
    source = F.when(F.col("tree") != "-", F.expr("substring(tree, instr(tree, ':') + 1)"))
    sources = roots(by_source).select(F.lit("").alias("tree"), F.col("tree").alias("name"), source.alias("source"), F.col("digest").alias("subroot"))
    top = hold(placed(hold(sources), ["source"]))
    over = levels(top.select("tree", "place", "size", F.col("subroot").alias("digest")), arity)
    start = roots(over).select("tree", F.col("digest").alias("root"), F.array().cast(_PATH).alias("path"))
    above = paths(over, hold(start), arity).join(top.drop("tree", "size"), "place").select(
        F.col("name").alias("tree"), "path", "subroot", "root")
    found = leaf_rows.join(paths(by_source, hold(above), arity), ["tree", "place"])
    release(rows)
    folded = fold(F.coalesce("other", "leaf"), F.col("path"))
    return found.select("doc_id", "leaf", "subroot", "root", proof(F.col("path")).alias("proof"), folded.alias("folded_root")).withColumn(
        "verified", F.col("folded_root") == F.col("root"))
