"""Time series (W5-W12, C10): calendar resampling, row-based rolling means,
month-over-month change, trend, cumulative revenue.

Row order is explicit and total: the date, then ``row_id`` if the series has such
a column, else the values themselves, so that rows of one date have one order
whatever the order of the input (rows equal in all of these are
interchangeable).  Positions and running sums come from ``order.prefixes`` (range
partitions of that order), rolling means from ``order.rolling_mean_rows`` (blocks
with a halo); none of them funnels the series, or a date, through one task.  Calendar spines are generated
from the min / max date (bounded by the calendar span, not by the data).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.order import prefixes, rolling_mean_rows, running_sum

D, REV, ORD = "date", "revenue", "orders"
# Trend interpretations.
TREND_UP = "Accelerating growth - maintain current strategy"
TREND_DOWN = "Declining momentum - investigate causes"
TREND_STABLE = "Stable momentum - maintain and monitor current strategy"


def _order(ts: DataFrame) -> list:
    return [F.col(D), F.col("row_id")] if "row_id" in ts.columns else [F.col(D), F.col(REV), F.col(ORD)]


def _resample(ts: DataFrame, label, step: str, spine_start, spine_end) -> DataFrame:
    agg = ts.groupBy(label.alias("period")).agg(
        F.sum(REV).alias("revenue_sum"), F.count(ORD).alias("orders_count"), F.avg(REV).alias("revenue_mean"))
    bounds = agg.agg(F.min("period").alias("a"), F.max("period").alias("b"))
    spine = bounds.select(F.explode(F.sequence(spine_start(F.col("a")), spine_start(F.col("b")),
                                               F.expr(f"INTERVAL {step}"))).alias("p0"))
    spine = spine.select(spine_end(F.col("p0")).alias("period"))
    out = spine.join(agg, "period", "left")
    return out.select("period", F.coalesce("revenue_sum", F.lit(0)).alias("revenue_sum"),
                      F.coalesce("orders_count", F.lit(0)).alias("orders_count"), "revenue_mean")


def weekly(ts: DataFrame) -> DataFrame:
    """Weeks ending Sunday; empty weeks present (sum 0, count 0, mean NULL)."""
    sunday = F.date_add(F.date_trunc("week", F.col(D)).cast("date"), 6)
    return _resample(ts, sunday, "7 DAYS", lambda c: c, lambda c: c)


def monthly(ts: DataFrame) -> DataFrame:
    return _resample(ts, F.last_day(F.col(D)), "1 MONTH", lambda c: F.trunc(c, "month"), F.last_day)


def mom_change(ts: DataFrame) -> DataFrame:
    """Monthly revenue with percent change vs the previous month (x 100).

    0 -> x is +/-Infinity and 0 -> 0 is NULL (pandas gives inf / NaN; ANSI Spark would fail).
    The window runs over the monthly table, one row per calendar month.
    """
    m = monthly(ts)
    prev = F.lag("revenue_sum").over(W.orderBy("period"))
    cur = F.col("revenue_sum")
    pct = (F.when(prev.isNull(), None)
           .when(prev != 0, (cur - prev) / prev * 100)
           .when(cur > 0, F.lit(float("inf"))).when(cur < 0, F.lit(float("-inf"))))
    return m.withColumn("mom_change_pct", pct.cast("double"))


def growth_decline(ts: DataFrame) -> DataFrame:
    m = mom_change(ts)
    return (m.filter((F.col("mom_change_pct") > 0) | (F.col("mom_change_pct") < 0))
            .select(F.col("period").alias("month"),
                    F.when(F.col("mom_change_pct") > 0, "growth").otherwise("decline").alias("kind"),
                    "mom_change_pct"))


def indexed(ts: DataFrame) -> DataFrame:
    return prefixes(ts, _order(ts), {}, "idx")


def rolling(ts: DataFrame) -> DataFrame:
    """MA7 and MA30 over rows (not calendar days), NULL until the window is full."""
    return _means(indexed(ts))


def _means(x: DataFrame) -> DataFrame:
    x = rolling_mean_rows(x, REV, "idx", 7, "revenue_ma7")
    return rolling_mean_rows(x, REV, "idx", 30, "revenue_ma30")


def cumulative(ts: DataFrame) -> DataFrame:
    return running_sum(ts, REV, "cumulative_revenue", _order(ts))


def chart_series(ts: DataFrame) -> DataFrame:
    return _means(prefixes(ts, _order(ts), {"cumulative_revenue": REV}, "idx"))


def trend(ts: DataFrame) -> DataFrame:
    """Direction and size of the change across the last 30 MA30 values; total revenue."""
    r = rolling(ts)
    n = ts.select(F.count(F.lit(1))).scalar()
    first_idx = F.greatest(F.lit(29), n - 30)
    ends = r.filter((F.col("idx") == first_idx) | (F.col("idx") == n - 1)).agg(
        F.min_by("revenue_ma30", "idx").alias("first"), F.max_by("revenue_ma30", "idx").alias("last"))
    change = F.col("last") - F.col("first")
    direction = F.when(change > 0, "up").when(change < 0, "down").otherwise("stable")
    total = ts.select(F.sum(REV)).scalar()
    return ends.select(
        direction.alias("trend_direction"), change.alias("change"),
        (F.try_divide(change, F.col("first")) * 100).alias("trend_magnitude_pct"),
        total.cast("double").alias("total_revenue"),
        F.when(direction == "up", TREND_UP).when(direction == "down", TREND_DOWN).otherwise(TREND_STABLE)
        .alias("business_interpretation"))


def highest_month(ts: DataFrame) -> DataFrame:
    """First month-end with the largest monthly revenue."""
    m = monthly(ts)
    return m.agg(F.min_by("period", F.struct((-F.col("revenue_sum")).alias("r"), F.col("period").alias("p")))
                 .alias("highest_revenue_month"), F.max("revenue_sum").alias("revenue_sum"))
