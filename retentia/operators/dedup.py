"""Duplicates (D1-D9, P1): exact / key duplicate statistics and audited deduplication.

Plan shape: the survivor of each key group is picked with
``row_number() OVER (PARTITION BY keys ORDER BY ...) = 1``.  Spark plans that
filter as a *partial* window group limit before the shuffle, so each input
partition ships at most one row per key — a key holding a third of the table
does not end up whole in one task.  Removed rows are the anti join on the
unique row id, which hashes evenly whatever the key skew.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

STRATEGIES = ("first", "last", "most_complete")
# The report's rationale text.
RATIONALE = ("Strategy 'most_complete' prioritizes records with maximum feature richness "
             "and fewest missing attributes when duplicate entity keys collide.")


def _data_cols(df: DataFrame, order_col: str | None) -> list[str]:
    return [c for c in df.columns if c != order_col]


def exact_duplicate_stats(df: DataFrame, order_col: str | None = "row_id") -> DataFrame:
    """exact_duplicate_rows, exact_duplicate_pct, has_exact_duplicates, total_rows_involved."""
    cols = _data_cols(df, order_col)
    g = df.groupBy(*cols).agg(F.count(F.lit(1)).alias("_n"))
    a = g.agg(F.sum("_n").alias("rows"), F.sum(F.col("_n") - 1).alias("dups"),
              F.sum(F.when(F.col("_n") > 1, F.col("_n")).otherwise(0)).alias("involved"))
    return a.select(
        F.coalesce("dups", F.lit(0)).cast("bigint").alias("exact_duplicate_rows"),
        F.round(F.coalesce("dups", F.lit(0)) / F.greatest(F.coalesce("rows", F.lit(0)), F.lit(1)) * 100, 2)
        .alias("exact_duplicate_pct"),
        (F.coalesce("dups", F.lit(0)) > 0).alias("has_exact_duplicates"),
        F.coalesce("involved", F.lit(0)).cast("bigint").alias("total_rows_involved"))


def key_duplicate_stats(df: DataFrame, business_keys: Sequence[str]) -> DataFrame:
    """Surplus rows per business key (exact copies included, as in the reference)."""
    missing = [k for k in business_keys if k not in df.columns]
    if missing:
        raise ValueError(f"Business keys not found in DataFrame: {missing}")
    g = df.groupBy(*business_keys).agg(F.count(F.lit(1)).alias("_n"))
    a = g.agg(F.sum("_n").alias("rows"), F.sum(F.col("_n") - 1).alias("dups"))
    return a.select(
        F.lit(", ".join(business_keys)).alias("business_keys"),
        F.coalesce("dups", F.lit(0)).cast("bigint").alias("key_duplicate_rows"),
        F.round(F.coalesce("dups", F.lit(0)) / F.greatest(F.coalesce("rows", F.lit(0)), F.lit(1)) * 100, 2)
        .alias("key_duplicate_pct"),
        (F.coalesce("dups", F.lit(0)) > 0).alias("has_near_duplicates"))


def _sort_exprs(sort_by: Sequence[str], ascending: bool) -> list[Column]:
    # pandas sort_values puts NULLs last in both directions.
    return [F.col(s).asc_nulls_last() if ascending else F.col(s).desc_nulls_last() for s in sort_by]


def survivor_order(df: DataFrame, strategy: str, sort_by: Sequence[str] | str | None,
                   ascending: bool, order_col: str) -> list[Column]:
    """Window order whose first row is the survivor of a key group."""
    if strategy not in STRATEGIES:
        raise ValueError(f"Unknown deduplication strategy: '{strategy}'. Choose 'first', 'last', or 'most_complete'.")
    sort_by = [sort_by] if isinstance(sort_by, str) else list(sort_by or [])
    base = _sort_exprs(sort_by, ascending) + [F.col(order_col).asc()]
    if strategy == "first":
        return base
    if strategy == "last":
        # The last row of the (stable) sorted order: reverse every component.
        rev = [F.col(s).desc_nulls_first() if ascending else F.col(s).asc_nulls_first() for s in sort_by]
        return rev + [F.col(order_col).desc()]
    complete = sum((F.col(c).isNotNull().cast("int") for c in _data_cols(df, order_col)), F.lit(0))
    return [complete.desc()] + base


def deduplicate(df: DataFrame, strategy: str = "most_complete", business_keys: Sequence[str] | None = None,
                sort_by=None, ascending: bool = True, order_col: str = "row_id") -> tuple[DataFrame, DataFrame]:
    """Return ``(kept, removed)``.  ``business_keys=None`` deduplicates on all data columns."""
    keys = list(business_keys) if business_keys else _data_cols(df, order_col)
    order = survivor_order(df, strategy, sort_by, ascending, order_col)
    w = W.partitionBy(*keys).orderBy(*order)
    kept = df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") == 1).drop("_rn")
    removed = df.join(kept.select(order_col), order_col, "left_anti")
    return kept, removed


def exact_dedup(df: DataFrame, order_col: str | None = "row_id") -> DataFrame:
    """``drop_duplicates()``: one row per distinct data row, keeping the first row id."""
    cols = _data_cols(df, order_col)
    if order_col is None:
        return df.dropDuplicates(cols)
    return df.groupBy(*cols).agg(F.min(order_col).alias(order_col)).select(*df.columns)


def removed_audit(removed: DataFrame, strategy: str, keys: Sequence[str], as_of: str,
                  order_col: str = "row_id") -> DataFrame:
    """Removed rows with the original row index and audit columns (fixed schema even when empty)."""
    return removed.select(
        *[c for c in removed.columns if c != order_col], F.col(order_col).alias("_orig_idx"),
        F.lit(strategy).alias("dedup_strategy"), F.lit(", ".join(keys)).alias("business_keys_used"),
        F.lit(as_of).alias("removal_timestamp"))


def dedup_metrics(df: DataFrame, kept: DataFrame, strategy: str, keys: Sequence[str]) -> DataFrame:
    before = df.select(F.count(F.lit(1))).scalar()
    return kept.agg(F.count(F.lit(1)).alias("rows_after")).select(
        F.lit(strategy).alias("strategy"), F.lit(", ".join(keys)).alias("business_keys"),
        before.alias("rows_before"), "rows_after",
        (before - F.col("rows_after")).alias("records_removed"),
        F.round((before - F.col("rows_after")) / F.greatest(before, F.lit(1)) * 100, 2).alias("percentage_removed"))


def dedup_report(metrics: DataFrame, exact_stats: DataFrame, as_of: str) -> DataFrame:
    """One-row nested report: rationale, exact-duplicate stats, dedup summary."""
    ex = exact_stats.select(F.struct(*exact_stats.columns).alias("s")).select("s").scalar()
    return metrics.select(
        F.lit(as_of).alias("timestamp"),
        F.struct(F.col("strategy").alias("strategy_chosen"),
                 F.split(F.col("business_keys"), ", ").alias("business_keys"),
                 F.lit(RATIONALE).alias("rationale")).alias("strategy_rationale"),
        ex.alias("exact_duplicates_detected"),
        F.struct(*metrics.columns).alias("deduplication_summary"))
