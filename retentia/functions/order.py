"""Row order without a single-partition window.

pandas frames carry an implicit row order; Spark frames do not.  Operators
that depend on order (forward fill, running sums, "the last N rows") take an
explicit order and run as *bucketed prefix* jobs:

1. every row gets a bucket that is monotone in the order: by default the
   range partition that it falls into, stored as a column of a materialized
   frame (``ranged``), so there are at most as many buckets as shuffle
   partitions; a caller may name another one of bounded number (month of a
   daily date);
2. one small aggregate per bucket (count, sum, last non-null value);
3. a window over the bucket summary (one row per bucket) gives each bucket
   the carry of all earlier buckets;
4. the carry joins back on the bucket and a window *partitioned by bucket*
   finishes the row-level result.

No step puts more than one bucket into one task, so a hot key cannot pin a
third of the table on one executor.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..session import materialize

BUCKET = "_bucket"


def ranged(df: DataFrame, order: list[Column]) -> DataFrame:
    """``df`` with ``BUCKET``, the number of the range partition of ``order`` that a row falls into.

    The frame is materialized: every later step sees the same boundaries.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    return materialize(df.repartitionByRange(n, *order).withColumn(BUCKET, F.spark_partition_id()))


def _bucketed(df: DataFrame, order: list[Column], bucket: Column | None) -> DataFrame:
    out = ranged(df, order) if bucket is None else df.withColumn(BUCKET, bucket)
    return out.withColumn("_okey", F.struct(*order))


def _bucket_summary_window():
    return W.orderBy(F.col(BUCKET)).rowsBetween(W.unboundedPreceding, -1)


def _join_carry(df: DataFrame, carry: DataFrame) -> DataFrame:
    # Bucket keys may contain NULL fields (e.g. a null sort date), so join null-safely.
    cond = df[BUCKET].eqNullSafe(carry[BUCKET])
    return df.join(carry, cond, "left").drop(carry[BUCKET])


def forward_fill(df: DataFrame, value, order: list[Column], bucket: Column | None = None,
                 back_fill_leading: bool = True) -> DataFrame:
    """Replace NULLs in ``value`` (a column name or a list of names) by the last
    non-null value earlier in ``order``.

    ``order`` must be a total order (end it with a unique row id).  Leading
    NULLs (before the first non-null) take the first non-null value when
    ``back_fill_leading`` — the ffill-then-bfill rule.  All columns share one
    bucket summary: per bucket the last and first non-null value of each
    column, one window over the summary for the carry (and the global first
    value), one join back, one in-bucket window.
    """
    values = [value] if isinstance(value, str) else list(value)
    tagged = _bucketed(df, order, bucket)
    aggs = []
    for i, v in enumerate(values):
        present = F.when(F.col(v).isNotNull(), F.col("_okey"))
        aggs += [F.max_by(F.col(v), present).alias(f"_last{i}"), F.min_by(F.col(v), present).alias(f"_first{i}")]
    summary = tagged.groupBy(BUCKET).agg(*aggs)
    w_before = _bucket_summary_window()
    w_all = W.orderBy(F.col(BUCKET)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    carry_cols = []
    for i in range(len(values)):
        carry_cols.append(F.last(f"_last{i}", ignorenulls=True).over(w_before).alias(f"_carry{i}"))
        if back_fill_leading:
            carry_cols.append(F.first(f"_first{i}", ignorenulls=True).over(w_all).alias(f"_lead{i}"))
    carry = summary.select(BUCKET, *carry_cols)
    w_in = W.partitionBy(BUCKET).orderBy(F.col("_okey")).rowsBetween(W.unboundedPreceding, 0)
    out = _join_carry(tagged, carry)
    fills = {}
    for i, v in enumerate(values):
        filled = F.coalesce(F.last(F.col(v), ignorenulls=True).over(w_in), F.col(f"_carry{i}"))
        if back_fill_leading:
            filled = F.coalesce(filled, F.col(f"_lead{i}"))
        fills[v] = filled
    out = out.withColumns(fills)
    drop = [BUCKET, "_okey"] + [c for c in out.columns if c.startswith("_carry") or c.startswith("_lead")]
    return out.drop(*drop)


def running_sum(df: DataFrame, value: str, out: str, order: list[Column], bucket: Column | None = None) -> DataFrame:
    """Cumulative sum of ``value`` along ``order`` (bucket sums + in-bucket running sum)."""
    tagged = _bucketed(df, order, bucket)
    summary = tagged.groupBy(BUCKET).agg(F.sum(value).alias("_bsum"))
    carry = summary.select(
        BUCKET, F.coalesce(F.sum("_bsum").over(_bucket_summary_window()), F.lit(0)).alias("_carry"))
    w_in = W.partitionBy(BUCKET).orderBy(F.col("_okey")).rowsBetween(W.unboundedPreceding, 0)
    res = _join_carry(tagged, carry).withColumn(out, F.sum(value).over(w_in) + F.col("_carry"))
    return res.drop(BUCKET, "_okey", "_carry")


def prefixes(df: DataFrame, order: list[Column], sums: dict[str, str], index: str) -> DataFrame:
    """``df`` with the 0-based position ``index`` and the running sum of each column of ``sums`` (new name -> column).

    One range partitioning and one bucket summary serve all of them.
    """
    tagged = _bucketed(df, order, None)
    before = _bucket_summary_window()
    own = {"_n": F.count(F.lit(1)), **{f"_s{i}": F.sum(v) for i, v in enumerate(sums.values())}}
    summary = tagged.groupBy(BUCKET).agg(*[e.alias(n) for n, e in own.items()])
    carry = summary.select(BUCKET, *[F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"_c{n}") for n in own])
    inside = W.partitionBy(BUCKET).orderBy(F.col("_okey"))
    res = _join_carry(tagged, carry).withColumn(index, F.row_number().over(inside) - 1 + F.col("_c_n"))
    upto = inside.rowsBetween(W.unboundedPreceding, 0)
    if sums:
        res = res.withColumns({out: F.coalesce(F.sum(v).over(upto), F.lit(0)) + F.col(f"_c_s{i}") for i, (out, v) in enumerate(sums.items())})
    return res.drop(BUCKET, "_okey", *[f"_c{n}" for n in own])


def row_index(df: DataFrame, out: str, order: list[Column], bucket: Column | None = None) -> DataFrame:
    """0-based position of each row in ``order`` (bucket counts + in-bucket row_number)."""
    tagged = _bucketed(df, order, bucket)
    summary = tagged.groupBy(BUCKET).agg(F.count(F.lit(1)).alias("_bcnt"))
    carry = summary.select(
        BUCKET, F.coalesce(F.sum("_bcnt").over(_bucket_summary_window()), F.lit(0)).alias("_carry"))
    w_in = W.partitionBy(BUCKET).orderBy(F.col("_okey"))
    res = _join_carry(tagged, carry).withColumn(out, F.row_number().over(w_in) - 1 + F.col("_carry"))
    return res.drop(BUCKET, "_okey", "_carry")


def rolling_mean_rows(df: DataFrame, value: str, index: str, window: int, out: str,
                      block: int = 1 << 16) -> DataFrame:
    """Mean of the last ``window`` rows by a dense 0-based ``index``; NULL until the window is full.

    Rows are cut into blocks of ``block`` consecutive indices; the last
    ``window - 1`` rows of each block are copied into the next block as a halo,
    so a window partitioned by block sees every row it needs.
    """
    halo = window - 1
    blk = F.floor(F.col(index) / block)
    in_halo = (F.col(index) % block) >= (block - halo) if halo > 0 else F.lit(False)
    copies = F.when(in_halo, F.array(F.struct(blk.alias("b"), F.lit(False).alias("h")),
                                     F.struct((blk + 1).alias("b"), F.lit(True).alias("h"))))\
        .otherwise(F.array(F.struct(blk.alias("b"), F.lit(False).alias("h"))))
    exploded = df.withColumn("_cp", F.explode(copies)).select("*", "_cp.b", "_cp.h").drop("_cp")
    w = W.partitionBy("b").orderBy(F.col(index)).rowsBetween(-halo, 0)
    res = exploded.withColumn(
        out, F.when(F.count(F.col(value)).over(w) == window, F.avg(F.col(value)).over(w)))
    return res.filter(~F.col("h")).drop("b", "h")
