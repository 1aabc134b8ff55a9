"""Sharding along a Hilbert curve, with DataFrame operations only.

Several metadata columns are quantised into ``2 ** BITS`` order-preserving steps,
the steps are mapped to their place on a Hilbert curve, and the curve is cut into
runs of equal row counts.  Steps hold similar numbers of rows: the cut points of
sizes are approximate quantiles over all rows, those of ``lang`` and ``source``
are whole values, found by counting every value and summing the counts in order.  A run covers a compact box in
every dimension, so a filter on any of them skips most files (``prune``).

Rows never meet in one sorted task: rows are counted by (curve cell, salt), two
small prefix sums give each of these groups its place, and only inside such a
group are rows numbered.  A cell with a third of all rows is ``SALTS`` groups.

Defined results: law ``rows``, shard sizes differ by at most one; a null text has
size 8 and crc32 0; a null or empty dimension is in the lowest step; rows of one
curve cell are ordered by a salt (a hash of the row), inside a salt by doc_id, size
and text checksum, and wholly equal rows take neighbouring slots in any order.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.order import running_sum
from .frames import hold

#: Quantisation steps per dimension: 2 ** BITS.
BITS = 4
SALTS = 1024
SHARDS = 24


def text_cuts(df: DataFrame, column: str, total: int, bits: int = BITS) -> list[tuple[str, int]]:
    """(value, step): at most 2 ** bits - 1 values of a text column that begin its steps, in order.

    A value's step is the share of rows before it, so a few values still spread over the
    whole curve and are told apart by its first turns.  Equal values collapse before the
    shuffle, and the counts are summed along range partitions; only the first
    value of each step comes to the driver.
    """
    counts = df.groupBy(F.coalesce(column, F.lit("")).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    upto = running_sum(counts, "n", "upto", [F.col("value")])
    steps = upto.select("value", F.expr(f"((upto - n) * {2**bits}) div {total}").alias("step"))
    firsts = steps.groupBy("step").agg(F.min("value").alias("value")).where("step > 0").collect()
    return sorted(((r["value"], r["step"]) for r in firsts), key=lambda cut: cut[1])


def text_step(c: Column, cuts: list[tuple[str, int]]) -> Column:
    """The step of the last cut at or below the value."""
    return F.coalesce(*[F.when(c >= F.lit(value), F.lit(at).cast("int")) for value, at in reversed(cuts)], F.lit(0))


def cut_points(df: DataFrame, columns: list[str], bits: int = BITS) -> dict[str, list[int]]:
    """At most 2 ** bits - 1 distinct increasing cut points per numeric column, from one pass over all rows."""
    at = [i / 2**bits for i in range(1, 2**bits)]
    row = df.agg(*[F.percentile_approx(c, at, 10_000).alias(c) for c in columns]).first()
    return {c: sorted(set(row[c] or [])) for c in columns}


def step(c: Column, cuts: list[int]) -> Column:
    """Number of cut points at or below the value."""
    return reduce(lambda a, b: a + b, [(c >= F.lit(x)).cast("int") for x in cuts], F.lit(0))


def curve_index(axes: list[Column], bits: int = BITS) -> Column:
    """Place on the Hilbert curve of a cell given by its steps.

    From the highest bit down, each plane's corner is reflected and rotated into
    the frame of the cell that holds it; Gray-code ranks of the planes, most
    significant first, make up the index.
    """
    n = len(axes)

    def turned(b: int, i: int):
        # Bit b of axis i set: flip the low bits of axis 0; else swap the low bits of axes 0 and i.
        q, low = F.lit(1 << b), F.lit((1 << b) - 1)

        def turn(x):
            head, own = F.element_at(x, 1), F.element_at(x, i + 1)
            is_set, differ = own.bitwiseAND(q) != 0, head.bitwiseXOR(own).bitwiseAND(low)
            parts = [F.element_at(x, k + 1) for k in range(n)]
            parts[0] = F.when(is_set, head.bitwiseXOR(low)).otherwise(head.bitwiseXOR(differ))
            if i:
                parts[i] = F.when(is_set, own).otherwise(own.bitwiseXOR(differ))
            return F.array(*parts)

        return turn

    state = F.array(*[a.cast("long") for a in axes])
    for b in range(bits - 1, 0, -1):
        for i in range(n):
            # transform() over a one-element array binds the previous state to a variable, so it is computed once.
            state = F.element_at(F.transform(F.array(state), turned(b, i)), 1)

    def rank(x):
        planes = []
        for b in range(bits - 1, -1, -1):
            for i in range(n):
                planes.append(F.shiftright(F.element_at(x, i + 1), b).bitwiseAND(F.lit(1)))
        index, carry = F.lit(0).cast("long"), F.lit(0).cast("long")
        terms = []
        for p in planes:  # prefix XOR turns the Gray code into a number
            carry = carry.bitwiseXOR(p)
            terms.append(carry)
        for k, t in enumerate(reversed(terms)):
            index = index + F.shiftleft(t, k)
        return index

    return F.element_at(F.transform(F.array(state), rank), 1)


def assign(docs: DataFrame, shards: int = SHARDS, bits: int = BITS) -> DataFrame:
    """(doc_id, size, text_crc32, lang, source, cell, law, shard, slot, grown_shard) for every row."""
    rows = docs.select(
        "doc_id", "lang", "source",
        (F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 8).alias("size"),
        F.crc32(F.encode(F.coalesce("text", F.lit("")), "utf-8")).alias("text_crc32"))
    rows = hold(rows)  # no texts: a few dozen bytes a row
    total = max(1, rows.count())
    steps = [text_step(F.coalesce(c, F.lit("")), text_cuts(rows, c, total, bits)) for c in ("lang", "source")]
    steps.append(step(F.col("size"), cut_points(rows, ["size"], bits)["size"]))
    celled = rows.withColumns({f"s{i}": s for i, s in enumerate(steps)})
    celled = celled.withColumn("cell", curve_index([F.col("s0"), F.col("s1"), F.col("s2")], bits))
    celled = celled.withColumn("salt", F.pmod(F.xxhash64("doc_id", "text_crc32", "size"), F.lit(SALTS)).cast("int"))
    counts = celled.groupBy("cell", "salt").agg(F.count(F.lit(1)).alias("n"))
    by_cell = counts.groupBy("cell").agg(F.sum("n").alias("cell_n"))  # at most 2 ** (3 * bits) rows
    before_cell = by_cell.select("cell", (F.sum("cell_n").over(Window.orderBy("cell")) - F.col("cell_n")).alias("cell_at"))
    in_cell = Window.partitionBy("cell").orderBy("salt")  # at most SALTS rows
    starts = counts.join(before_cell, "cell").select(
        "cell", "salt", (F.col("cell_at") + F.sum("n").over(in_cell) - F.col("n")).alias("start"))
    group = Window.partitionBy("cell", "salt").orderBy("doc_id", "size", "text_crc32")
    placed = celled.withColumn("nth", F.row_number().over(group) - 1).join(starts, ["cell", "salt"])
    at = F.col("start") + F.col("nth")
    placed = placed.withColumn("at", at).withColumn("shard", F.expr(f"int((at * {shards}) div {total})"))
    first = F.expr(f"(shard * {total} + {shards - 1}) div {shards}")  # first place p with (p * shards) div total = shard
    return placed.select("doc_id", "size", "text_crc32", "lang", "source", "cell", F.lit("rows").alias("law"), "shard",
                         (F.col("at") - first).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def manifest(assigned: DataFrame) -> DataFrame:
    """One row per shard: rows, bytes and the range of each dimension."""
    return assigned.groupBy("shard").agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum("size").alias("bytes"),
        *[f(c).alias(f"{n}_{c}") for c in ("lang", "source", "size") for n, f in (("min", F.min), ("max", F.max))],
        *[F.max(F.col(c).isNull()).alias(f"null_{c}") for c in ("lang", "source")])


def prune(manifest_: DataFrame, **equal) -> DataFrame:
    """Shards of the manifest that can hold rows with the given values, e.g. ``source='src3'``."""
    for c, v in equal.items():
        manifest_ = manifest_.where((F.col(f"min_{c}") <= F.lit(v)) & (F.col(f"max_{c}") >= F.lit(v)))
    return manifest_


def write(assigned: DataFrame, path: str) -> None:
    """One folder per shard; a shard's files hold ranges of its slots, in order, so no task writes a whole shard."""
    assigned.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def read(spark: SparkSession, path: str, shards: list[int]) -> DataFrame:
    return spark.read.parquet(path).where(F.col("shard").isin(shards))
