"""Profiling and quality (Q1-Q8): shape, completeness, uniqueness, numeric and
categorical distributions, IQR outliers and a quality score.

The reference scans the frame once per column and per statistic.  Here the
numeric profile is one long ``(column, value)`` projection: one grouped
aggregate for the moments, one radix selection for the quartiles,
and one grouped count for the outliers — the work does not multiply with the
number of columns.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.types import BooleanType, NumericType, StringType

from ..functions.stats import column_quantiles
from ..session import materialize
from .dedup import exact_duplicate_stats
from .missing import is_missing

# Name fragments that mark a column whose values must not be negative.
NON_NEGATIVE_TERMS = ["revenue", "duration", "count", "tickets"]


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, NumericType) and not isinstance(f.dataType, BooleanType)]


def categorical_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, (StringType, BooleanType))]


def profile_shape(df: DataFrame, name: str = "dataset") -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("total_rows")).select(
        F.lit(name).alias("dataset"), "total_rows", F.lit(len(df.columns)).cast("bigint").alias("total_columns"),
        F.lit(",".join(df.columns)).alias("columns"))


def profile_completeness(df: DataFrame) -> DataFrame:
    """Per column: null_count, null_percentage, is_complete; plus the overall completeness."""
    cols = df.columns
    wide = df.agg(F.count(F.lit(1)).alias("__rows"),
                  *[F.count_if(is_missing(df, c)).alias(f"__n{i}") for i, c in enumerate(cols)])
    total_missing = sum((F.col(f"__n{i}") for i in range(len(cols))), F.lit(0))
    cells = F.col("__rows") * len(cols)
    overall = F.round((cells - total_missing) / F.greatest(cells, F.lit(1)) * 100, 2)
    rows = wide.select(overall.alias("overall_completeness_pct"), "__rows", F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(f"__n{i}").alias("null_count")) for i, c in enumerate(cols)
    ])).alias("r"))
    return rows.select(
        "r.column", "r.null_count",
        F.round(F.col("r.null_count") / F.greatest(F.col("__rows"), F.lit(1)) * 100, 2).alias("null_percentage"),
        (F.col("r.null_count") == 0).alias("is_complete"), "overall_completeness_pct")


def profile_uniqueness(df: DataFrame, primary_key: str | None = None) -> DataFrame:
    ex = exact_duplicate_stats(df, order_col=None)
    out = ex.select("exact_duplicate_rows", "exact_duplicate_pct",
                    (F.col("exact_duplicate_rows") == 0).alias("is_unique"))
    if primary_key and primary_key in df.columns:
        pk = df.groupBy(primary_key).agg(F.count(F.lit(1)).alias("_n")).agg(
            F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).cast("bigint").alias("d"))
        d = pk.select("d").scalar()
        out = out.select("*", F.lit(primary_key).alias("primary_key"), d.alias("primary_key_duplicates"),
                         (d == 0).alias("primary_key_unique"))
    return out


def _r(x: float, digits: int) -> float:
    """Round half up on the shortest decimal text, as Spark's ``round`` does (keeps driver-side
    results identical to the column expressions used everywhere else)."""
    from decimal import ROUND_HALF_UP, Decimal
    return float(Decimal(repr(float(x))).quantize(Decimal(1).scaleb(-digits), rounding=ROUND_HALF_UP))


def profile_numeric(df: DataFrame) -> DataFrame:
    """pandas-style numeric profile per column, 4 dp; all-null columns are skipped.

    Count, mean, minimum and maximum of all columns are one wide aggregate, the
    central moments behind the sample std and the corrected skewness (two-pass,
    numerically stable) and the IQR outlier counts a second one; neither
    shuffles rows.  The quartiles of all columns come from one radix selection.
    """
    cols = numeric_columns(df)
    spark = df.sparkSession
    if not cols:
        return spark.createDataFrame([], _NUMERIC_SCHEMA)

    def value(c):
        v = F.col(c).cast("double")
        return F.when(~F.isnan(v), v)

    at = {c: i for i, c in enumerate(cols)}
    first = df.agg(*[f(value(c)).alias(f"{n}{i}") for c, i in at.items()
                     for n, f in (("n", F.count), ("mean", F.avg), ("min", F.min), ("max", F.max))]).first()
    cols = [c for c in cols if first[f"n{at[c]}"]]
    if not cols:
        return spark.createDataFrame([], _NUMERIC_SCHEMA)
    quartiles = column_quantiles(df, cols, [0.25, 0.5, 0.75])
    qrows = {c: dict(zip(("q25", "median", "q75"), quartiles[c])) for c in cols}
    aggs = []
    for c in cols:
        i, q = at[c], qrows[c]
        iqr = q["q75"] - q["q25"]
        d = value(c) - F.lit(first[f"mean{i}"])
        outside = (value(c) < F.lit(q["q25"] - 1.5 * iqr)) | (value(c) > F.lit(q["q75"] + 1.5 * iqr))
        aggs += [F.sum(d * d).alias(f"m2{i}"), F.sum(d * d * d).alias(f"m3{i}"), F.count_if(outside).alias(f"out{i}")]
    central = df.agg(*aggs).first()
    rows = []
    for c in cols:
        i, q = at[c], qrows[c]
        n, squares = int(first[f"n{i}"]), central[f"m2{i}"]
        m2, m3 = squares / n, central[f"m3{i}"] / n
        std = math.sqrt(squares / (n - 1)) if n > 1 else 0.0
        skew = (m3 / m2 ** 1.5) * math.sqrt(n * (n - 1)) / (n - 2) if n > 2 and m2 > 0 else 0.0
        rows.append((c, n, _r(first[f"mean{i}"], 4), _r(std, 4), _r(first[f"min{i}"], 4), _r(q["q25"], 4),
                     _r(q["median"], 4), _r(q["q75"], 4), _r(first[f"max{i}"], 4), _r(q["q75"] - q["q25"], 4),
                     _r(skew, 4), int(central[f"out{i}"]), _r(int(central[f"out{i}"]) / max(n, 1) * 100, 2)))
    # One row per profiled column, assembled from the small per-column results.
    return spark.createDataFrame(rows, _NUMERIC_SCHEMA)


_NUMERIC_SCHEMA = ("column string, count bigint, mean double, std double, min double, q25 double, median double, "
                   "q75 double, max double, iqr double, skewness double, outlier_count bigint, outlier_pct double")


def profile_outliers(df: DataFrame) -> DataFrame:
    p = profile_numeric(df)
    # Fences from the 4-dp quartiles have at most 5 decimals: round there, not at a tie.
    return p.select("column", F.round(F.col("q25") - 1.5 * F.col("iqr"), 5).alias("lower_bound"),
                    F.round(F.col("q75") + 1.5 * F.col("iqr"), 5).alias("upper_bound"),
                    "outlier_count", "outlier_pct")


def profile_categorical(df: DataFrame, max_top: int = 5) -> DataFrame:
    """String and boolean columns: non-null count, distinct count, cardinality % and top values.

    One row per (column, top value).  Ties in counts go to the smaller value
    (pandas keeps first-seen order, which a distributed scan does not have).
    """
    cols = categorical_columns(df)
    if not cols:
        return df.sparkSession.createDataFrame([], "column string, total_non_null bigint, unique_values bigint, "
                                                   "cardinality_pct double, top_rank int, top_value string, top_count bigint")
    longf = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("v")) for c in cols])).alias("r")
    ).select("r.column", "r.v").filter(F.col("v").isNotNull())
    counts = longf.groupBy("column", "v").agg(F.count(F.lit(1)).alias("n"))
    summary = counts.groupBy("column").agg(F.sum("n").alias("total_non_null"),
                                           F.count(F.lit(1)).alias("unique_values"))
    rows = df.select(F.count(F.lit(1))).scalar()
    w = W.partitionBy("column").orderBy(F.col("n").desc(), F.col("v").asc())
    top = counts.withColumn("top_rank", F.row_number().over(w)).filter(F.col("top_rank") <= max_top)
    return summary.join(top, "column", "left").select(
        "column", "total_non_null", "unique_values",
        F.round(F.col("unique_values") / F.greatest(rows, F.lit(1)) * 100, 2).alias("cardinality_pct"),
        F.col("top_rank").cast("int").alias("top_rank"), F.col("v").alias("top_value"), F.col("n").alias("top_count"))


def _py_list(names: list[str]) -> str:
    return "[" + ", ".join(f"'{n}'" for n in names) + "]"


def assess_quality(df: DataFrame) -> DataFrame:
    """Quality score: 0.5 x completeness + 0.3 x uniqueness - 10 per critical issue (max 80 by design)."""
    cols = df.columns
    num = numeric_columns(df)
    watched = [c for c in num if any(t in c.lower() for t in NON_NEGATIVE_TERMS)]
    wide = df.agg(F.count(F.lit(1)).alias("rows"),
                  *[F.count_if(is_missing(df, c)).alias(f"n_{i}") for i, c in enumerate(cols)],
                  *[F.count_if(F.col(c) < 0).alias(f"neg_{i}") for i, c in enumerate(watched)])
    dups = exact_duplicate_stats(df, order_col=None).select("exact_duplicate_rows").scalar()
    rows = F.col("rows")
    high_null = F.filter(F.array(*[F.when(F.col(f"n_{i}") / F.greatest(rows, F.lit(1)) > 0.2, F.lit(c))
                                   for i, c in enumerate(cols)]), lambda x: x.isNotNull())
    quoted = F.transform(high_null, lambda x: F.concat(F.lit("'"), x, F.lit("'")))
    issue_high = F.when(F.size(high_null) > 0, F.concat(
        F.lit("High missingness (>20%) detected in: ["), F.array_join(quoted, ", "), F.lit("]")))
    neg_issues = [F.when(F.col(f"neg_{i}") > 0, F.lit(f"Negative values found in non-negative domain column '{c}'"))
                  for i, c in enumerate(watched)]
    issues = F.filter(F.array(issue_high, *neg_issues), lambda x: x.isNotNull())
    missing = sum((F.col(f"n_{i}") for i in range(len(cols))), F.lit(0))
    cells = rows * len(cols)
    comp = F.greatest(F.lit(0.0), 100 - missing / F.greatest(cells, F.lit(1)) * 100)
    uniq = F.greatest(F.lit(0.0), 100 - dups / F.greatest(rows, F.lit(1)) * 100)
    score = F.round(F.greatest(F.lit(0.0), comp * 0.5 + uniq * 0.3 - F.size(issues) * 10), 1)
    warn = F.when(dups > 0, F.concat(F.lit("Found "), dups.cast("string"), F.lit(" exact duplicate rows ("),
                                     F.round(dups / rows * 100, 1).cast("string"), F.lit("%)")))
    return wide.select(
        score.alias("overall_quality_score"),
        F.when(score >= 90, "EXCELLENT").when(score >= 75, "GOOD").otherwise("NEEDS_ATTENTION").alias("quality_status"),
        F.round(comp, 1).alias("completeness_score"), F.round(uniq, 1).alias("uniqueness_score"),
        F.array_join(issues, " | ").alias("critical_issues"),
        F.coalesce(warn, F.lit("")).alias("warnings"))


def dataset_profile(df: DataFrame, name: str = "dataset", primary_key: str | None = None,
                    as_of: str = "1970-01-01T00:00:00") -> DataFrame:
    """One-row nested report of Q1-Q7.

    Each part is small (a row per column at most) and is checkpointed before it
    is nested, so the report plan does not re-derive every part's shuffles.
    """
    def nest(part: DataFrame):
        part = materialize(part)
        return part.select(F.collect_list(F.struct(*part.columns)).alias("x")).select("x").scalar()

    def one(part: DataFrame):
        part = materialize(part)
        return part.select(F.struct(*part.columns).alias("x")).select("x").scalar()
    comp = profile_completeness(df)
    return df.sparkSession.range(1).select(
        F.lit(as_of).alias("timestamp"), F.lit(name).alias("dataset_name"),
        one(profile_shape(df, name)).alias("shape"),
        nest(comp).alias("completeness"),
        one(profile_uniqueness(df, primary_key)).alias("uniqueness"),
        nest(profile_numeric(df)).alias("numerical_distributions"),
        nest(profile_categorical(df)).alias("categorical_distributions"),
        one(assess_quality(df)).alias("quality_assessment"))
