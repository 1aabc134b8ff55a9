"""Correlation analysis (A23-A29, F2, F11): Pearson and Spearman matrices, comparison
with the target, strong pairs, feature selection, least-squares line.

Pearson for every pair comes from ONE aggregate of ``covar_pop`` / ``stddev_pop``
(guarded so a constant column yields NULL instead of an ANSI divide error).
Spearman ranks are computed per feature from value counts: a prefix count over
the distinct values (a window per feature when the distinct count is checked
small, range partitioning otherwise) gives each value its average rank (ties
averaged); the ranks join back by value and feed the same Pearson aggregate.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.stats import pearson, prefix_counts
from ..session import materialize

FEATURES = ["engagement", "transactions_per_month", "support_tickets", "churn"]
TARGET = "churn"
# Business interpretation texts for the support-tickets / churn pair.
INTERPRETATION_PAIR = "support_tickets <-> churn"
INTERPRETATION_DIRECTIONS = [
    "support_tickets -> churn (customer gives up after contacting support)",
    "churn -> support_tickets (unhappy customers contact support before leaving)",
    "customer_pain -> both (underlying issue causes both)",
]
INTERPRETATION_DATA = "Correlation alone cannot establish causation; customer pain may confound both measures."
INTERPRETATION_ACTION = "Focus on reducing customer pain and improving support outcomes, not blocking tickets."


def pearson_matrix(df: DataFrame, features: Sequence[str] = FEATURES) -> DataFrame:
    """Long matrix (feature_a, feature_b, pearson) with every ordered pair, from one aggregate."""
    fs = list(features)
    cells = [(a, b) for a in fs for b in fs]
    wide = df.agg(*[pearson(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"c{i}")
                    for i, (a, b) in enumerate(cells)])
    return wide.select(F.explode(F.array(*[
        F.struct(F.lit(a).alias("feature_a"), F.lit(b).alias("feature_b"), F.col(f"c{i}").alias("r"))
        for i, (a, b) in enumerate(cells)])).alias("x")).select("x.*")


#: Groups over which the rows of one hot value are spread.
RANK_SALTS = 64


def average_ranks(df: DataFrame, features: Sequence[str], row_key: str) -> DataFrame:
    """Wide frame (_row, <feature>...) of average ranks (ties share the mean rank); ``row_key`` must be unique."""
    fs = list(features)
    longf = df.select(F.col(row_key).alias("_row"), F.explode(F.array(*[
        F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("v")) for f in fs])).alias("x")
    ).select("_row", "x.feature", "x.v")
    counts = longf.groupBy("feature", "v").agg(F.count(F.lit(1)).alias("c"))
    # Average rank of a value = rows before it + (ties + 1) / 2.
    cum = materialize(prefix_counts(counts, "feature", "v", "c"))
    ranks = cum.select("feature", "v", (F.col("_cum") - F.col("c") + (F.col("c") + 1) / 2.0).alias("rank"))
    # A value such as churn = 0 holds most of a feature's rows: rows find their rank by (value, salt), and the
    # rank table gets a row for each salt that occurs, never more than RANK_SALTS for one value.
    salted = longf.withColumn("salt", F.pmod(F.xxhash64("_row"), F.lit(RANK_SALTS)).cast("int"))
    by_salt = salted.select("feature", "v", "salt").distinct().join(ranks, ["feature", "v"])
    ranked = salted.join(by_salt, ["feature", "v", "salt"], "inner")
    return ranked.groupBy("_row").agg(*[F.max(F.when(F.col("feature") == f, F.col("rank"))).alias(f) for f in fs])


def spearman_matrix(df: DataFrame, features: Sequence[str] = FEATURES, row_key: str = "customer_id") -> DataFrame:
    return pearson_matrix(average_ranks(df, features, row_key), features)


def compare_with_target(df: DataFrame, features: Sequence[str] = FEATURES, target: str = TARGET,
                        row_key: str = "customer_id") -> DataFrame:
    p = pearson_matrix(df, features).filter(F.col("feature_b") == target).select(
        F.col("feature_a").alias("feature"), F.col("r").alias("pearson"))
    s = spearman_matrix(df, features, row_key).filter(F.col("feature_b") == target).select(
        F.col("feature_a").alias("feature"), F.col("r").alias("spearman"))
    return p.join(s, "feature", "inner")


def strong_pairs(df: DataFrame, features: Sequence[str] = FEATURES, threshold: float = 0.7, top: int = 10) -> DataFrame:
    """Upper-triangle pairs (name order), |r| > threshold and r != 1.0, strongest signed first, top 10."""
    m = pearson_matrix(df, features)
    cand = m.filter((F.col("feature_a") < F.col("feature_b")) & F.col("r").isNotNull() & ~F.isnan("r")
                    & (F.abs("r") > threshold) & (F.col("r") != 1.0))
    return cand.orderBy(F.col("r").desc(), "feature_a", "feature_b").limit(top)


def interpretation(df: DataFrame) -> DataFrame:
    r = df.agg(pearson(F.col("support_tickets").cast("double"), F.col("churn").cast("double")).alias("correlation"))
    return r.select(F.lit(INTERPRETATION_PAIR).alias("pair"), "correlation",
                    F.lit(" | ".join(INTERPRETATION_DIRECTIONS)).alias("possible_directions"),
                    F.lit(INTERPRETATION_DATA).alias("data_indicates"), F.lit(INTERPRETATION_ACTION).alias("action"))


def select_features(df: DataFrame, drop: str = "engagement") -> DataFrame:
    return df.drop(drop)


def least_squares(df: DataFrame, x: str, y: str, points: int = 100) -> DataFrame:
    """Degree-1 fit: slope, intercept, and ``points`` evenly spaced (x, y_hat) over [min x, max x]."""
    fit = df.agg(F.regr_slope(F.col(y), F.col(x)).alias("slope"), F.regr_intercept(F.col(y), F.col(x)).alias("intercept"),
                 F.min(x).alias("x0"), F.max(x).alias("x1"))
    grid = fit.select("*", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("i"))
    xv = F.col("x0") + (F.col("x1") - F.col("x0")) * F.col("i") / (points - 1)
    return grid.select(F.col("i").cast("int").alias("point"), "slope", "intercept", xv.alias("x"),
                       (F.col("slope") * xv + F.col("intercept")).alias("y_hat"))
