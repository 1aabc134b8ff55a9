"""Segment analysis (A12-A16, W1-W3, W13, K1) and its display tables.

Group-bys run on the raw rows (partial aggregation map-side); ranks, shares
and arg-max run on the aggregated result, whose size is the number of
segments, so an unpartitioned window there touches a handful of rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.numfmt import fmt_fixed, fmt_money, fmt_percent
from ..session import materialize

SEG = "customer_type"

# Insight actions by churn threshold.
ACTION_HIGH = "HIGH PRIORITY: Churn above 10%. Investigate pain points."
ACTION_HEALTHY = "Healthy. Maintain current service level."
ACTION_MONITOR = "Monitor. No immediate action needed."
# Strategy narrative actions.
STRATEGY_PREMIUM = "Maintain premium support and proactive retention programs"
STRATEGY_ONBOARD = "Improve onboarding and guided support to reduce churn risk"
STRATEGY_SCALE = "Scale self-service education while monitoring churn"


def _keyed(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    # pandas groupby drops NULL keys; Spark would keep a NULL group.
    cond = None
    for k in keys:
        c = F.col(k).isNotNull()
        cond = c if cond is None else cond & c
    return df.filter(cond)


def segment_metrics(df: DataFrame) -> DataFrame:
    return _keyed(df, [SEG]).groupBy(SEG).agg(
        F.avg("churn").alias("churn_rate"), F.sum("revenue").alias("total_revenue"),
        F.count("customer_id").alias("customer_count"), F.avg("support_tickets").alias("avg_support_tickets"))


def segment_ranked(df: DataFrame) -> DataFrame:
    m = segment_metrics(df)
    return m.select(
        "*", F.dense_rank().over(W.orderBy(F.col("churn_rate").desc())).cast("double").alias("churn_rank"),
        (F.col("total_revenue") / F.sum("total_revenue").over(W.partitionBy()) * 100).alias("revenue_contribution"))


def segment_worst_first(df: DataFrame) -> DataFrame:
    return segment_ranked(df).orderBy(F.col("churn_rate").desc(), F.col(SEG))


def segment_product(df: DataFrame) -> DataFrame:
    return _keyed(df, [SEG, "product"]).groupBy(SEG, "product").agg(
        F.sum("revenue").alias("total_revenue"), F.count("customer_id").alias("customer_count"))


#: Most products that become columns; a wider table belongs in the long form (``segment_product``).
MAX_PIVOT_COLUMNS = 10_000


def _products(long: DataFrame) -> list[str]:
    """The products of an aggregated (segment, product) table, all of them."""
    found = [r[0] for r in long.select("product").distinct().orderBy("product").limit(MAX_PIVOT_COLUMNS + 1).collect()]
    if len(found) > MAX_PIVOT_COLUMNS:
        raise ValueError(f"more than {MAX_PIVOT_COLUMNS} products cannot become columns; use segment_product")
    return found


def segment_product_unstacked(df: DataFrame) -> DataFrame:
    """Products to columns for both measures, absent cells 0: ``total_revenue_<p>``, ``customer_count_<p>``."""
    sp = materialize(segment_product(df))  # one row per segment and product
    ps = _products(sp)
    aggs = [F.coalesce(F.sum(F.when(F.col("product") == p, F.col(m))), F.lit(0)).alias(f"{m}_{p}")
            for m in ("total_revenue", "customer_count") for p in ps]
    return sp.groupBy(SEG).agg(*aggs) if aggs else sp.select(SEG)


def revenue_pivot(df: DataFrame) -> DataFrame:
    long = materialize(_keyed(df, [SEG, "product"]).groupBy(SEG, "product").agg(F.sum("revenue").alias("revenue")))
    ps = _products(long)
    return long.groupBy(SEG).pivot("product", ps).agg(F.sum("revenue")).na.fill(0, subset=ps)


def segment_insights(df: DataFrame) -> DataFrame:
    r = segment_ranked(df)
    action = (F.when(F.col("churn_rate") > 0.10, ACTION_HIGH)
              .when(F.col("churn_rate") < 0.02, ACTION_HEALTHY).otherwise(ACTION_MONITOR))
    return r.select(
        F.col(SEG).alias("segment"), F.col("customer_count").cast("bigint").alias("customer_count"),
        fmt_percent("churn_rate", 1).alias("churn_rate"),
        fmt_money("total_revenue", 0, commas=False).alias("total_revenue"),
        F.concat(fmt_fixed("revenue_contribution", 1), F.lit("%")).alias("revenue_contribution"),
        action.alias("action"))


def strategy_metrics(df: DataFrame) -> DataFrame:
    return _keyed(df, [SEG]).groupBy(SEG).agg(
        F.avg("lifetime_value").alias("avg_ltv"), F.avg("churn").alias("churn_rate"),
        F.avg("support_tickets").alias("avg_tickets"), F.avg("retention_days").alias("avg_retention"),
        F.count("customer_id").alias("count"))


def strategy_ranked(df: DataFrame) -> DataFrame:
    m = strategy_metrics(df)
    return m.select(
        "*", F.dense_rank().over(W.orderBy(F.col("avg_ltv").desc())).cast("double").alias("ltv_rank"),
        F.dense_rank().over(W.orderBy(F.col("churn_rate").asc())).cast("double").alias("churn_rank"),
        (F.col("count") / F.sum("count").over(W.partitionBy()) * 100).alias("segment_share_pct"))


def strategy_summary(df: DataFrame) -> DataFrame:
    r = strategy_ranked(df)
    return r.select(
        SEG, "avg_ltv", fmt_money("avg_ltv", 0, commas=True).alias("avg_ltv_display"), "ltv_rank",
        "churn_rate", fmt_percent("churn_rate", 1).alias("churn_rate_display"), "churn_rank",
        fmt_fixed("avg_tickets", 2).alias("avg_tickets_display"),
        F.concat(fmt_fixed("avg_retention", 0), F.lit(" days")).alias("avg_retention_display"),
        "count", F.concat(fmt_fixed("segment_share_pct", 1), F.lit("%")).alias("segment_share_display"))


def strategy_performers(df: DataFrame) -> DataFrame:
    """Top LTV, top churn and best retention segment; ties go to the first in LTV-desc order."""
    m = strategy_metrics(df)
    tie = [(-F.col("avg_ltv")).alias("l"), F.col(SEG).alias("s")]

    def top(metric):
        return F.min_by(F.struct(F.col(SEG).alias("name"), F.col(metric).alias("value")),
                        F.struct((-F.col(metric)).alias("m"), *tie))
    a = m.agg(top("avg_ltv").alias("a"), top("churn_rate").alias("b"), top("avg_retention").alias("c"))
    def row(insight, src, metric):
        return F.struct(F.lit(insight).alias("insight"), F.col(f"{src}.name").alias("segment"),
                        F.lit(metric).alias("metric"), F.col(f"{src}.value").alias("value"))
    return a.select(F.explode(F.array(
        row("highest_value_segment", "a", "avg_ltv"), row("highest_churn_segment", "b", "churn_rate"),
        row("best_retention_segment", "c", "avg_retention"))).alias("x")).select("x.*")


def strategy_narrative(df: DataFrame) -> DataFrame:
    """The business summary text, one row per line: (line_no, line)."""
    r = strategy_ranked(df)
    pos = F.row_number().over(W.orderBy(F.col("avg_ltv").desc(), F.col(SEG))) - 1
    action = (F.when((F.col("avg_ltv") > 50000) & (F.col("churn_rate") <= 0.05), STRATEGY_PREMIUM)
              .when(F.col("churn_rate") > 0.10, STRATEGY_ONBOARD).otherwise(STRATEGY_SCALE))
    head = F.concat(F.col(SEG), F.lit(" ("), fmt_fixed("segment_share_pct", 1), F.lit("% of base, "),
                    fmt_money("avg_ltv", 0, commas=True), F.lit(" avg LTV, "), fmt_percent("churn_rate", 1),
                    F.lit(" churn):"))
    lines = r.select(pos.alias("p"), head.alias("h"), F.concat(F.lit("- Action: "), action).alias("a"))
    body = lines.select(F.explode(F.array(
        F.struct((F.col("p") * 2 + 1).alias("line_no"), F.col("h").alias("line")),
        F.struct((F.col("p") * 2 + 2).alias("line_no"), F.col("a").alias("line")))).alias("x")).select("x.*")
    title = df.sparkSession.range(1).select(F.lit(0).alias("line_no"), F.lit("SEGMENT STRATEGY SUMMARY:").alias("line"))
    return title.unionByName(body)


def heatmap_segments(df: DataFrame) -> DataFrame:
    """Long form of the strategy heatmap: (customer_type, metric, value)."""
    m = strategy_metrics(df)
    return m.unpivot(SEG, ["avg_ltv", "churn_rate", "avg_tickets", "avg_retention"], "metric", "value")
