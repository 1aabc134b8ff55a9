"""Missing values (M1-M9): detection, row drops, forward fill, median / mode imputation,
treatment log and before/after report.

Each stage depends on the previous one (the median is taken after rows are
dropped), so each adds one small aggregate; every aggregate is a partial
(map-side) aggregate or a scalar subquery, never a collect.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType, NumericType

from ..functions.order import forward_fill
from ..session import materialize
from ..functions.stats import column_quantiles, mode_value

# The treatment log's reasoning texts.
REASON_DROP = ("Dropped {n} rows with missing critical identifier '{c}'. "
               "Primary keys cannot be reliably imputed without introducing artificial identity collisions.")
REASON_FFILL = ("Forward-filled {n} missing values in time-series column '{c}'. "
                "Assumes temporal state continuity until subsequent observation.")
REASON_MEDIAN = ("Imputed {n} missing values in '{c}' using column median ({v}). "
                 "Median is chosen over mean because it is robust against outliers and distribution skewness.")
REASON_MODE = ("Imputed {n} missing values in '{c}' using category mode ('{v}'). "
               "Preserves categorical distribution mode without introducing synthetic arbitrary categories.")



def is_missing(df: DataFrame, c: str) -> Column:
    """pandas ``isna``: NULL, and NaN for floating columns."""
    dt = df.schema[c].dataType
    if isinstance(dt, (DoubleType, FloatType)):
        return F.col(c).isNull() | F.isnan(F.col(c))
    return F.col(c).isNull()


def nan_to_null(df: DataFrame) -> DataFrame:
    """Turn NaN into NULL in every floating column (done once, at the edge)."""
    return df.withColumns({f.name: F.nanvl(F.col(f.name), F.lit(None).cast(f.dataType))
                           for f in df.schema.fields if isinstance(f.dataType, (DoubleType, FloatType))})


def detect_missing(df: DataFrame) -> DataFrame:
    """Per column: null_count, null_percentage (2 dp), has_missing, dtype — one aggregate."""
    cols = df.columns
    wide = df.agg(F.count(F.lit(1)).alias("__rows"),
                  *[F.count_if(is_missing(df, c)).alias(f"__n{i}") for i, c in enumerate(cols)])
    rows = wide.select("__rows", F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(f"__n{i}").alias("null_count"),
                 F.lit(df.schema[c].dataType.simpleString()).alias("dtype"), F.lit(i).alias("position"))
        for i, c in enumerate(cols)])).alias("r"))
    return rows.select(
        "r.column", "r.position", "r.null_count",
        F.round(F.col("r.null_count") / F.greatest(F.col("__rows"), F.lit(1)) * 100, 2).alias("null_percentage"),
        (F.col("r.null_count") > 0).alias("has_missing"), "r.dtype")


def missing_totals(df: DataFrame) -> DataFrame:
    """One row: total_rows, total_columns, total_missing_cells, total_cells, overall_missing_pct."""
    cols = df.columns
    miss = sum((F.count_if(is_missing(df, c)) for c in cols), F.lit(0)) if cols else F.lit(0)
    agg = df.agg(F.count(F.lit(1)).alias("total_rows"), miss.cast("bigint").alias("total_missing_cells"))
    return agg.select(
        "total_rows", F.lit(len(cols)).cast("bigint").alias("total_columns"), "total_missing_cells",
        (F.col("total_rows") * len(cols)).alias("total_cells"),
        F.round(F.col("total_missing_cells") / F.greatest(F.col("total_rows") * len(cols), F.lit(1)) * 100, 2)
        .alias("overall_missing_pct"))


def _log_row(spark, column: str, strategy: str, affected: int, value: Column, reason: Column) -> DataFrame:
    """One log row from a count that one aggregate over all treated columns has found."""
    return spark.range(1).select(F.lit(affected).cast("bigint").alias("affected_records")).select(
        F.lit(column).alias("column"), F.lit(strategy).alias("strategy"),
        F.col("affected_records"), value.cast("string").alias("imputed_value"), reason.alias("reasoning"))


def _null_counts(df: DataFrame, conditions: dict[str, Column]) -> dict[str, int]:
    """Rows for which each condition holds, by name, from one pass."""
    if not conditions:
        return {}
    names = list(conditions)
    row = df.agg(*[F.count_if(conditions[n]).alias(f"n{i}") for i, n in enumerate(names)]).first()
    return {n: int(row[f"n{i}"]) for i, n in enumerate(names)}


def _fmt(template: str, **kw: Column) -> Column:
    """Fill ``{name}`` slots of a fixed text with column values."""
    parts = []
    rest = template
    while "{" in rest:
        pre, _, tail = rest.partition("{")
        key, _, rest = tail.partition("}")
        parts += [F.lit(pre), kw[key].cast("string")]
    parts.append(F.lit(rest))
    return F.concat(*parts)


def _py_float_text(c: Column) -> Column:
    """Python ``str(float)`` for the logged median, rounded to four places (``12.0``, ``0.5``, ``12345678.5``, ``0.0005``).

    Python writes doubles from 1e-4 up to below 1e16 without an exponent; a value of four decimal places
    is then its decimal text without trailing zeros, but for one.
    """
    text = F.regexp_replace(c.cast("decimal(38,4)").cast("string"), r"(\.\d+?)0+$", "$1")
    whole = c.cast("string")
    plain = (F.abs(c) < 1e16) & ((F.abs(c) >= 1e-4) | (c == 0))
    return F.when(plain, text).otherwise(F.lower(F.regexp_replace(whole, r"\.0E|E", "e+")))


def handle_missing_values(df: DataFrame, critical_identifiers: Sequence[str] = (),
                          numerical_median_cols: Sequence[str] = (), categorical_mode_cols: Sequence[str] = (),
                          time_series_cols: Sequence[str] = (), date_sort_col: str | None = None,
                          order_col: str = "row_id", checkpoint: bool = True) -> tuple[DataFrame, DataFrame]:
    """Drop -> forward fill -> median -> mode, in the reference's order.

    Returns ``(cleaned, log)``; the log has a row per treated column that had
    NULLs: (column, strategy, affected_records, imputed_value, reasoning, step).
    ``order_col`` is the row order (file order) used to break ties.

    With ``checkpoint`` the frame is checkpointed (to the shared checkpoint
    folder) after the fill stage: the median and mode stages and the log all
    read it, and re-deriving the fill for each of them would repeat its shuffles.
    """
    cur = nan_to_null(df)
    logs: list[DataFrame] = []
    step = 0

    def add(log_df):
        nonlocal step
        logs.append(log_df.withColumn("step", F.lit(step)))
        step += 1

    spark = df.sparkSession
    # Dropped rows per identifier (of the rows that the earlier ones left) and gaps in the filled columns: one pass.
    critical = [c for c in critical_identifiers if c in cur.columns]
    ts_cols = [c for c in time_series_cols if c in cur.columns]
    left, conditions = F.lit(True), {}
    for c in critical:
        conditions[f"drop {c}"] = left & F.col(c).isNull()
        left = left & F.col(c).isNotNull()
    conditions.update({f"fill {c}": left & F.col(c).isNull() for c in ts_cols})
    counts = _null_counts(cur, conditions)
    for c in critical:
        add(_log_row(spark, c, "drop_rows", counts[f"drop {c}"], F.lit(None),
                     _fmt(REASON_DROP, n=F.col("affected_records"), c=F.lit(c))))
        cur = cur.filter(F.col(c).isNotNull())
    if time_series_cols:
        # The frame is sorted once, before any column is filled: freeze the sort key.
        if date_sort_col and date_sort_col in cur.columns:
            cur = cur.withColumn("__sort_d", F.col(date_sort_col))
            d = F.col("__sort_d")
            order = [d.isNull(), d, F.col(order_col)]
        else:
            order = [F.col(order_col)]
        for c in ts_cols:
            add(_log_row(spark, c, "forward_fill", counts[f"fill {c}"], F.lit("propagated_prior_value"),
                         _fmt(REASON_FFILL, n=F.col("affected_records"), c=F.lit(c))))
        if ts_cols:
            cur = forward_fill(cur, ts_cols, order, back_fill_leading=True)
        if "__sort_d" in cur.columns:
            cur = cur.drop("__sort_d")
        if checkpoint:
            cur = materialize(cur)
    # No later step changes which cells of another column are missing, so one pass counts them all; a column that is
    # treated twice is counted again when its second turn comes.
    imputed = [c for c in (*numerical_median_cols, *categorical_mode_cols) if c in cur.columns]
    counts = _null_counts(cur, {c: F.col(c).isNull() for c in imputed})
    treated: set[str] = set()

    def missing_now(c):
        n = _null_counts(cur, {c: F.col(c).isNull()})[c] if c in treated else counts[c]
        treated.add(c)
        return n

    # Filling a column changes no other column's median, nor its own, so one selection serves all of them.
    medians = column_quantiles(cur, [c for c in numerical_median_cols if c in cur.columns], [0.5])
    for c in numerical_median_cols:
        if c not in cur.columns:
            continue
        med = F.lit(medians[c][0]).cast("double")
        n = missing_now(c)
        shown = _py_float_text(F.round(med, 4))
        add(_log_row(spark, c, "median_imputation", n, shown,
                     _fmt(REASON_MEDIAN, n=F.col("affected_records"), c=F.lit(c), v=shown)))
        cur = cur.withColumn(c, F.coalesce(_widen(cur, c), med))
    for c in categorical_mode_cols:
        if c not in cur.columns:
            continue
        found = mode_value(cur, c).first()["mode"]
        mode = F.lit("Unknown" if found is None else str(found))
        n = missing_now(c)
        add(_log_row(spark, c, "mode_imputation", n, mode,
                     _fmt(REASON_MODE, n=F.col("affected_records"), c=F.lit(c), v=mode)))
        cur = cur.withColumn(c, F.coalesce(F.col(c).cast("string"), mode))
    if logs:
        log = logs[0]
        for lg in logs[1:]:
            log = log.unionByName(lg)
        log = log.filter(F.col("affected_records") > 0)
    else:
        log = df.sparkSession.createDataFrame(
            [], "column string, strategy string, affected_records bigint, imputed_value string, reasoning string, step int")
    return cur, log


def imputation_report(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row: rows and missing cells before / after, completeness percentages.

    The "before" totals enter as scalar subqueries (each one row), so no join is needed.
    """
    b = missing_totals(before)
    rows_b = b.select("total_rows").scalar()
    cells_b = b.select("total_missing_cells").scalar()
    pct_b = b.select("overall_missing_pct").scalar()
    return missing_totals(after).select(
        rows_b.alias("rows_before"), F.col("total_rows").alias("rows_after"),
        (rows_b - F.col("total_rows")).alias("rows_removed"),
        cells_b.alias("missing_cells_before"),
        F.col("total_missing_cells").alias("missing_cells_after"),
        F.round(100 - pct_b, 2).alias("completeness_before_pct"),
        F.round(100 - F.col("overall_missing_pct"), 2).alias("completeness_after_pct"))


def _widen(df: DataFrame, c: str) -> Column:
    """Median fill yields DOUBLE, as pandas' float64 column does once it holds a NaN."""
    dt = df.schema[c].dataType
    return F.col(c) if isinstance(dt, (DoubleType, FloatType)) else F.col(c).cast("double")


def median_fill_numeric(df: DataFrame) -> DataFrame:
    """Fill every numeric column's NULLs with its exact median (one selection for all columns)."""
    num = [f.name for f in df.schema.fields if isinstance(f.dataType, NumericType)]
    if not num:
        return df
    meds = {c: m for c, (m,) in column_quantiles(df, num, [0.5]).items()}
    fills = {c: F.coalesce(_widen(df, c), F.lit(meds.get(c)).cast("double")) for c in num}
    return df.withColumns(fills)
