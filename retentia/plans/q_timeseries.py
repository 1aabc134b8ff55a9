"""Time-series queries (S13, W5-W12, C10) over the ``daily revenue`` adapter."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import timeseries as tsr
from ..sources import adapters as ad
from ..sources.loaders import load_time_series
from . import sql_adapters as S
from .registry import r6, register

T = S.with_(S.DAILY)


def ts(spark, sf):
    return load_time_series(ad.daily_revenue(spark, sf))


@register("load_time_series", T + "SELECT date, revenue, orders FROM daily")
def q_load(spark, sf):
    return ts(spark, sf)


def _resample_sql(label, step, start, end):
    return f"""agg AS (SELECT {label} AS period, sum(revenue) AS s, count(orders) AS c, avg(revenue) AS m FROM daily GROUP BY 1),
spine AS (SELECT {end} AS period FROM (SELECT unnest(generate_series({start.format('min(period)')}, {start.format('max(period)')}, INTERVAL {step})) AS p0 FROM agg))
SELECT spine.period, round(coalesce(s, 0), 2) AS revenue_sum, coalesce(c, 0) AS orders_count, round(m, 6) AS revenue_mean
FROM spine LEFT JOIN agg USING (period)"""


_WEEK = _resample_sql("CAST(date_trunc('week', date) + INTERVAL 6 DAY AS DATE)", "7 DAY", "{}", "CAST(p0 AS DATE)")
_MONTH_AGG = ("agg AS (SELECT last_day(date) AS period, sum(revenue) AS s, count(orders) AS c, avg(revenue) AS m "
              "FROM daily GROUP BY 1)")
_MONTH_SPINE = ("spine AS (SELECT last_day(CAST(p0 AS DATE)) AS period FROM (SELECT unnest(generate_series("
                "CAST(date_trunc('month', min(period)) AS DATE), CAST(date_trunc('month', max(period)) AS DATE), "
                "INTERVAL 1 MONTH)) AS p0 FROM agg))")
_MONTHLY = S.with_(S.DAILY, _MONTH_AGG, _MONTH_SPINE, """mon AS (SELECT spine.period, coalesce(s, 0) AS revenue_sum,
  coalesce(c, 0) AS orders_count, m AS revenue_mean FROM spine LEFT JOIN agg USING (period))""",
                   """mom AS (SELECT *, CASE WHEN lag(revenue_sum) OVER (ORDER BY period) IS NULL THEN NULL
  WHEN lag(revenue_sum) OVER (ORDER BY period) <> 0
    THEN (revenue_sum - lag(revenue_sum) OVER (ORDER BY period)) / lag(revenue_sum) OVER (ORDER BY period) * 100
  WHEN revenue_sum > 0 THEN 'Infinity'::DOUBLE WHEN revenue_sum < 0 THEN '-Infinity'::DOUBLE END AS mom_change_pct FROM mon)""")


def _r(df, cols2=("revenue_sum",), cols4=()):
    out = []
    for c in df.columns:
        if c in cols2:
            out.append(F.round(c, 2).alias(c))
        elif c in cols4:
            out.append(F.round(c, 4).alias(c))
        elif c == "revenue_mean":
            out.append(F.round(c, 6).alias(c))
        else:
            out.append(F.col(c))
    return df.select(*out)


@register("ts_weekly", T + ", " + _WEEK)
def q_weekly(spark, sf):
    return _r(tsr.weekly(ts(spark, sf)))


@register("ts_monthly", _MONTHLY + """
SELECT period, round(revenue_sum, 2) AS revenue_sum, orders_count, round(revenue_mean, 6) AS revenue_mean FROM mon""")
def q_monthly(spark, sf):
    return _r(tsr.monthly(ts(spark, sf)))


@register("ts_mom_change", _MONTHLY + """
SELECT period, round(revenue_sum, 2) AS revenue_sum, orders_count, round(revenue_mean, 6) AS revenue_mean,
       round(mom_change_pct, 6) AS mom_change_pct FROM mom""")
def q_mom(spark, sf):
    return _r(tsr.mom_change(ts(spark, sf))).withColumn("mom_change_pct", r6("mom_change_pct"))


@register("ts_growth_decline", _MONTHLY + """
SELECT period AS month, CASE WHEN mom_change_pct > 0 THEN 'growth' ELSE 'decline' END AS kind,
       round(mom_change_pct, 6) AS mom_change_pct FROM mom WHERE mom_change_pct > 0 OR mom_change_pct < 0""")
def q_growth(spark, sf):
    return tsr.growth_decline(ts(spark, sf)).withColumn("mom_change_pct", r6("mom_change_pct"))


_ROLL = """roll AS (SELECT date, revenue, orders, row_number() OVER (ORDER BY date) - 1 AS idx,
  CASE WHEN count(revenue) OVER (ORDER BY date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) = 7
       THEN avg(revenue) OVER (ORDER BY date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) END AS revenue_ma7,
  CASE WHEN count(revenue) OVER (ORDER BY date ROWS BETWEEN 29 PRECEDING AND CURRENT ROW) = 30
       THEN avg(revenue) OVER (ORDER BY date ROWS BETWEEN 29 PRECEDING AND CURRENT ROW) END AS revenue_ma30,
  sum(revenue) OVER (ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cumulative_revenue
  FROM daily)"""


@register("ts_rolling", S.with_(S.DAILY, _ROLL) + """
SELECT date, round(revenue, 2) AS revenue, orders, idx, round(revenue_ma7, 4) AS revenue_ma7,
       round(revenue_ma30, 4) AS revenue_ma30 FROM roll""")
def q_rolling(spark, sf):
    r = tsr.rolling(ts(spark, sf))
    return r.select("date", F.round("revenue", 2).alias("revenue"), "orders", "idx",
                    F.round("revenue_ma7", 4).alias("revenue_ma7"), F.round("revenue_ma30", 4).alias("revenue_ma30"))


@register("ts_cumulative", S.with_(S.DAILY, _ROLL) + """
SELECT date, round(revenue, 2) AS revenue, orders, round(cumulative_revenue, 2) AS cumulative_revenue FROM roll""")
def q_cumulative(spark, sf):
    c = tsr.cumulative(ts(spark, sf))
    return c.select("date", F.round("revenue", 2).alias("revenue"), "orders",
                    F.round("cumulative_revenue", 2).alias("cumulative_revenue"))


@register("ts_chart_series", S.with_(S.DAILY, _ROLL) + """
SELECT date, round(revenue, 2) AS revenue, round(revenue_ma7, 4) AS revenue_ma7, round(revenue_ma30, 4) AS revenue_ma30,
       round(cumulative_revenue, 2) AS cumulative_revenue FROM roll""")
def q_series(spark, sf):
    c = tsr.chart_series(ts(spark, sf))
    return c.select("date", F.round("revenue", 2).alias("revenue"), F.round("revenue_ma7", 4).alias("revenue_ma7"),
                    F.round("revenue_ma30", 4).alias("revenue_ma30"),
                    F.round("cumulative_revenue", 2).alias("cumulative_revenue"))


_BY_ORDER = "ORDER BY date, row_id ROWS BETWEEN"


@register("ts_order_series", f"""
WITH daily AS (SELECT CAST(o_orderdate AS DATE) AS date, o_totalprice AS revenue, o_orderkey AS row_id FROM orders)
SELECT row_id, date, round(revenue, 2) AS revenue, row_number() OVER (ORDER BY date, row_id) - 1 AS idx,
  CASE WHEN count(*) OVER ({_BY_ORDER} 6 PRECEDING AND CURRENT ROW) = 7
       THEN round(avg(revenue) OVER ({_BY_ORDER} 6 PRECEDING AND CURRENT ROW), 4) END AS revenue_ma7,
  CASE WHEN count(*) OVER ({_BY_ORDER} 29 PRECEDING AND CURRENT ROW) = 30
       THEN round(avg(revenue) OVER ({_BY_ORDER} 29 PRECEDING AND CURRENT ROW), 4) END AS revenue_ma30,
  round(sum(revenue) OVER ({_BY_ORDER} UNBOUNDED PRECEDING AND CURRENT ROW), 2) AS cumulative_revenue
FROM daily""")
def q_order_series(spark, sf):
    """The series of single orders: many rows of one date, in the order of (date, row_id)."""
    rows = ad.table(spark, sf, "orders").select(F.col("o_orderdate").cast("date").alias("date"), F.col("o_totalprice").alias("revenue"),
                                                F.lit(1).alias("orders"), F.col("o_orderkey").alias("row_id"))
    c = tsr.chart_series(rows)
    return c.select("row_id", "date", F.round("revenue", 2).alias("revenue"), "idx", F.round("revenue_ma7", 4).alias("revenue_ma7"),
                    F.round("revenue_ma30", 4).alias("revenue_ma30"), F.round("cumulative_revenue", 2).alias("cumulative_revenue"))


@register("ts_trend", S.with_(S.DAILY, _ROLL) + """
SELECT CASE WHEN lst - fst > 0 THEN 'up' WHEN lst - fst < 0 THEN 'down' ELSE 'stable' END AS trend_direction,
       round(lst - fst, 4) AS change, round((lst - fst) / fst * 100, 6) AS trend_magnitude_pct,
       round(total, 2) AS total_revenue,
       CASE WHEN lst - fst > 0 THEN 'Accelerating growth - maintain current strategy'
            WHEN lst - fst < 0 THEN 'Declining momentum - investigate causes'
            ELSE 'Stable momentum - maintain and monitor current strategy' END AS business_interpretation
FROM (SELECT (SELECT revenue_ma30 FROM roll WHERE idx = greatest(29, (SELECT count(*) FROM daily) - 30)) AS fst,
             (SELECT revenue_ma30 FROM roll WHERE idx = (SELECT count(*) FROM daily) - 1) AS lst,
             (SELECT sum(revenue) FROM daily) AS total)""")
def q_trend(spark, sf):
    t = tsr.trend(ts(spark, sf))
    return t.select("trend_direction", F.round("change", 4).alias("change"),
                    r6("trend_magnitude_pct").alias("trend_magnitude_pct"),
                    F.round("total_revenue", 2).alias("total_revenue"), "business_interpretation")


@register("ts_highest_month", S.with_(S.DAILY, _MONTH_AGG) + """
SELECT arg_min(period, (-s, period)) AS highest_revenue_month, round(max(s), 2) AS revenue_sum FROM agg""")
def q_highest(spark, sf):
    h = tsr.highest_month(ts(spark, sf))
    return h.select("highest_revenue_month", F.round("revenue_sum", 2).alias("revenue_sum"))
