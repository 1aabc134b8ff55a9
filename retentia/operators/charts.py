"""Chart tables (C1-C5, C11): the data behind each business chart, not the pictures.

Input columns: order_date (DATE), product_line, order_amount, marketing_spend.
All grouping happens on the raw rows with partial aggregation; the rest runs
on the aggregated month x product / quarter x product tables, whose size is
bounded by calendar span times the number of product lines.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numfmt import fmt_currency_compact, fmt_fixed
from ..functions.stats import pearson
from ..session import materialize
from .correlation import least_squares

# Order-value histogram edges (last bin closed).
ORDER_BINS = [0, 50, 100, 150, 200, 250, 300, 400]
# Chart questions and annotations.
QUESTIONS = {
    "chart1": "Which product line generates the most revenue in the last quarter?",
    "chart2": "How has monthly revenue changed over 12 months for top products?",
    "chart3": "What order value ranges occur most frequently?",
    "chart4": "How does product-line composition contribute to quarterly revenue?",
    "chart5": "Does higher marketing spend correlate with higher revenue?",
}
ANNOTATIONS = {
    "chart1": "Arrow highlights the highest-revenue product for prioritization.",
    "chart2": "Marker identifies the monthly revenue dip to trigger root-cause review.",
    "chart3": "Callout marks the dominant bin that drives transaction volume.",
    "chart4": "Callout highlights the dominant product share in the latest quarter.",
    "chart5": "Callout marks the weakest-performing spend-to-revenue outlier.",
}


def _keyed(df: DataFrame, *keys: str) -> DataFrame:
    """pandas ``groupby`` drops NULL keys; Spark would keep a NULL group."""
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(k).isNotNull()
    return df.filter(cond)


def revenue_by_product(df: DataFrame, days: int = 90) -> DataFrame:
    """Last ``days`` days (inclusive lower bound, no upper bound) revenue per product line, plus the leader flag."""
    end = df.select(F.max("order_date")).scalar()
    recent = _keyed(df, "product_line").filter(F.col("order_date") >= F.date_sub(end, days))
    agg = recent.groupBy("product_line").agg(F.sum("order_amount").alias("revenue"))
    leader = agg.select(F.max_by("product_line", F.struct("revenue", "product_line"))).scalar()
    return agg.withColumn("is_leader", F.col("product_line") == leader)


def _month(c="order_date"):
    return F.trunc(F.col(c), "month")


def monthly_by_product(df: DataFrame) -> DataFrame:
    return _keyed(df, "order_date", "product_line").groupBy(_month().alias("month"), "product_line").agg(F.sum("order_amount").alias("order_amount"))


def top_products(monthly: DataFrame, k: int = 3) -> DataFrame:
    """Top ``k`` product lines by total revenue (ties: product name)."""
    tot = monthly.groupBy("product_line").agg(F.sum("order_amount").alias("t"))
    return tot.orderBy(F.col("t").desc(), "product_line").limit(k).select("product_line")


def monthly_top3(df: DataFrame) -> DataFrame:
    m = monthly_by_product(df)
    # k rows: a proven-size broadcast for the semi join.
    return m.join(F.broadcast(top_products(m, 3)), "product_line", "left_semi")


def trough_month(df: DataFrame) -> DataFrame:
    """Month with the lowest combined top-3 revenue (first such month)."""
    agg = monthly_top3(df).groupBy("month").agg(F.sum("order_amount").alias("order_amount"))
    return agg.agg(F.min_by("month", F.struct("order_amount", "month")).alias("month"),
                   F.min("order_amount").alias("order_amount"))


def order_histogram(df: DataFrame, edges: Sequence[float] = ORDER_BINS) -> DataFrame:
    """Counts per fixed bin; half-open bins, last one closed; values outside are dropped; empty bins kept."""
    e = list(edges)
    v = F.col("order_amount")
    idx = None
    for i in range(len(e) - 1):
        cond = (v >= e[i]) & ((v < e[i + 1]) if i < len(e) - 2 else (v <= e[i + 1]))
        idx = F.when(cond, F.lit(i)) if idx is None else idx.when(cond, F.lit(i))
    counts = df.select(idx.alias("bin")).filter(F.col("bin").isNotNull()).groupBy("bin").agg(
        F.count(F.lit(1)).alias("count"))
    spine = df.sparkSession.createDataFrame([(i, float(e[i]), float(e[i + 1])) for i in range(len(e) - 1)],
                                            "bin int, bin_start double, bin_end double")
    return spine.join(counts, "bin", "left").select("bin", "bin_start", "bin_end",
                                                    F.coalesce("count", F.lit(0)).cast("bigint").alias("count"))


def _quarter(c="order_date"):
    return F.concat(F.year(c).cast("string"), F.lit("Q"), F.quarter(c).cast("string"))


def quarterly_composition(df: DataFrame) -> DataFrame:
    """Long (quarter, product_line, revenue, quarter_total, share), 0 where a product sold nothing.

    Every product that the data holds appears in every quarter: the products come from the
    aggregated (quarter, product) table, which has a few rows per quarter.
    """
    cells = _keyed(df, "order_date", "product_line").groupBy(_quarter().alias("quarter"), "product_line").agg(
        F.sum("order_amount").cast("double").alias("revenue"))
    quarters = cells.groupBy("quarter").agg(F.sum("revenue").alias("quarter_total"))
    # The result itself has a row for every quarter and product, so this spine is no larger than it.
    spine = quarters.crossJoin(cells.select("product_line").distinct())
    longf = spine.join(cells, ["quarter", "product_line"], "left").withColumn("revenue", F.coalesce("revenue", F.lit(0.0)))
    return longf.select("quarter", "product_line", "revenue", "quarter_total",
                        (F.col("revenue") / F.col("quarter_total")).alias("share"))


def quarter_dominant(df: DataFrame) -> DataFrame:
    comp = quarterly_composition(df)
    last_q = comp.select(F.max("quarter")).scalar()
    lq = comp.filter(F.col("quarter") == last_q)
    return lq.agg(F.first("quarter").alias("quarter"),
                  F.min_by("product_line", F.struct((-F.col("share")).alias("s"), F.col("product_line").alias("p")))
                  .alias("dominant_product"), F.max("share").alias("share"))


def marketing_points(df: DataFrame) -> DataFrame:
    return _keyed(df, "order_date", "product_line").groupBy(_month().alias("month"), "product_line").agg(
        F.sum("order_amount").alias("revenue"), F.sum("marketing_spend").alias("marketing_spend"))


def marketing_corr(df: DataFrame) -> DataFrame:
    p = marketing_points(df)
    r = p.agg(pearson("marketing_spend", "revenue").alias("correlation"))
    return r.select("correlation", F.when(F.col("correlation") >= 0.7, "strong").otherwise("moderate").alias("strength"))


def trend_line(df: DataFrame, points: int = 100) -> DataFrame:
    return least_squares(marketing_points(df), "marketing_spend", "revenue", points)


def marketing_outlier(df: DataFrame) -> DataFrame:
    """The product-month with the most negative residual from the least-squares line."""
    p = marketing_points(df)
    fit = p.agg(F.regr_slope("revenue", "marketing_spend").alias("m"), F.regr_intercept("revenue", "marketing_spend").alias("b"))
    m, b = fit.select("m").scalar(), fit.select("b").scalar()
    res = p.withColumn("residual", F.col("revenue") - (m * F.col("marketing_spend") + b))
    pick = F.min_by(F.struct("month", "product_line", "revenue", "marketing_spend", "residual"),
                    F.struct("residual", "month", "product_line"))
    return res.agg(pick.alias("x")).select("x.*")


def chart_notes(df: DataFrame) -> DataFrame:
    """Question, key insight and annotation text per chart.

    The revenue charts share one table of sums by day and product line; only the histogram reads the orders again.
    """
    orders = df
    df = materialize(orders.groupBy("order_date", "product_line").agg(
        F.sum("order_amount").alias("order_amount"), F.sum("marketing_spend").alias("marketing_spend")))
    rbp = revenue_by_product(df).filter("is_leader").select(
        F.concat(F.col("product_line"), F.lit(" leads with "), fmt_currency_compact("revenue"), F.lit(".")).alias("t"))
    dip = trough_month(df).select(F.concat(F.lit("The combined top-3 revenue trough occurs in "),
                                           F.date_format("month", "MMM yyyy"), F.lit(".")).alias("t"))
    hist = order_histogram(orders)
    peak = hist.agg(F.min_by(F.struct("bin_start", "bin_end"), F.struct((-F.col("count")).alias("c"), F.col("bin").alias("b"))).alias("p"))
    peak_t = peak.select(F.concat(F.lit("Peak concentration is near $"),
                                  fmt_fixed((F.col("p.bin_start") + F.col("p.bin_end")) / 2, 0),
                                  F.lit(" order values.")).alias("t"))
    dom = quarter_dominant(df).select(
        F.concat(F.col("dominant_product"), F.lit(" contributes the largest share in the latest quarter.")).alias("t"))
    corr = marketing_corr(df).select(F.concat(F.lit("The relationship is "), F.col("strength"), F.lit(" with r="),
                                              fmt_fixed("correlation", 2), F.lit(".")).alias("t"))
    parts = []
    for name, t in [("chart1", rbp), ("chart2", dip), ("chart3", peak_t), ("chart4", dom), ("chart5", corr)]:
        parts.append(t.select(F.lit(name).alias("chart"), F.lit(QUESTIONS[name]).alias("question"),
                              F.col("t").alias("key_insight"), F.lit(ANNOTATIONS[name]).alias("annotation")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
