"""Chart-table queries (C1-C5, C11, F3-F5, F9, J1, K2, A28, A29) over the ``chart orders`` adapter."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.numfmt import fmt_currency_compact
from ..operators import charts as ch
from ..sources import adapters as ad
from . import sql_adapters as S
from .registry import r6, register

CH = S.with_(S.CHART)


def orders(spark, sf):
    return ad.chart_orders(spark, sf)


@register("chart_revenue_by_product", CH + """, agg AS (
  SELECT product_line, sum(order_amount) AS revenue FROM chart
  WHERE order_date >= (SELECT max(order_date) FROM chart) - INTERVAL 90 DAY GROUP BY product_line)
SELECT product_line, round(revenue, 4) AS revenue,
       product_line = (SELECT arg_max(product_line, (revenue, product_line)) FROM agg) AS is_leader FROM agg""")
def q_rbp(spark, sf):
    return ch.revenue_by_product(orders(spark, sf)).select("product_line", F.round("revenue", 4).alias("revenue"), "is_leader")


_MONTHLY = """m AS (SELECT CAST(date_trunc('month', order_date) AS DATE) AS month, product_line, sum(order_amount) AS order_amount
  FROM chart GROUP BY ALL),
top3 AS (SELECT product_line FROM m GROUP BY product_line ORDER BY sum(order_amount) DESC, product_line LIMIT 3),
mt AS (SELECT * FROM m WHERE product_line IN (SELECT product_line FROM top3))"""


@register("chart_monthly_top3", CH + ", " + _MONTHLY + " SELECT month, product_line, round(order_amount, 4) AS order_amount FROM mt")
def q_top3(spark, sf):
    return ch.monthly_top3(orders(spark, sf)).withColumn("order_amount", F.round("order_amount", 4))


@register("chart_trough_month", CH + ", " + _MONTHLY + """
SELECT arg_min(month, (s, month)) AS month, round(min(s), 4) AS order_amount
FROM (SELECT month, sum(order_amount) AS s FROM mt GROUP BY month)""")
def q_trough(spark, sf):
    return ch.trough_month(orders(spark, sf)).withColumn("order_amount", F.round("order_amount", 4))


@register("chart_order_histogram", CH + """
SELECT b.bin, CAST(b.bin_start AS DOUBLE) AS bin_start, CAST(b.bin_end AS DOUBLE) AS bin_end, CAST(coalesce(c.n, 0) AS BIGINT) AS count FROM
 (VALUES (0, 0.0, 50.0), (1, 50.0, 100.0), (2, 100.0, 150.0), (3, 150.0, 200.0), (4, 200.0, 250.0), (5, 250.0, 300.0),
         (6, 300.0, 400.0)) b(bin, bin_start, bin_end)
LEFT JOIN (SELECT CASE WHEN order_amount >= 0 AND order_amount < 50 THEN 0 WHEN order_amount >= 50 AND order_amount < 100 THEN 1
   WHEN order_amount >= 100 AND order_amount < 150 THEN 2 WHEN order_amount >= 150 AND order_amount < 200 THEN 3
   WHEN order_amount >= 200 AND order_amount < 250 THEN 4 WHEN order_amount >= 250 AND order_amount < 300 THEN 5
   WHEN order_amount >= 300 AND order_amount <= 400 THEN 6 END AS bin, count(*) AS n FROM chart GROUP BY 1) c USING (bin)""")
def q_hist(spark, sf):
    h = ch.order_histogram(orders(spark, sf))
    return h.withColumn("bin", F.col("bin").cast("int"))


_QUARTERS = """q AS (SELECT CAST(year(order_date) AS VARCHAR) || 'Q' || CAST(quarter(order_date) AS VARCHAR) AS quarter,
  product_line, sum(order_amount) AS revenue FROM chart GROUP BY ALL),
qs AS (SELECT DISTINCT quarter FROM q),
full_q AS (SELECT qs.quarter, p.product_line, coalesce(q.revenue, 0.0) AS revenue
  FROM qs CROSS JOIN (SELECT DISTINCT product_line FROM chart) p LEFT JOIN q USING (quarter, product_line)),
comp AS (SELECT quarter, product_line, revenue, sum(revenue) OVER (PARTITION BY quarter) AS quarter_total,
  revenue / sum(revenue) OVER (PARTITION BY quarter) AS share FROM full_q)"""


@register("chart_quarterly_composition", S.with_(S.CHART, _QUARTERS) + """
SELECT quarter, product_line, round(revenue, 4) AS revenue, round(quarter_total, 4) AS quarter_total, round(share, 6) AS share FROM comp""")
def q_quarterly(spark, sf):
    c = ch.quarterly_composition(orders(spark, sf))
    return c.select("quarter", "product_line", F.round("revenue", 4).alias("revenue"),
                    F.round("quarter_total", 4).alias("quarter_total"), r6("share").alias("share"))


@register("chart_quarter_dominant", S.with_(S.CHART, _QUARTERS) + """
SELECT quarter, arg_min(product_line, (-share, product_line)) AS dominant_product, round(max(share), 6) AS share
FROM comp WHERE quarter = (SELECT max(quarter) FROM comp) GROUP BY quarter""")
def q_dominant(spark, sf):
    return ch.quarter_dominant(orders(spark, sf)).withColumn("share", r6("share"))


_POINTS = """pts AS (SELECT CAST(date_trunc('month', order_date) AS DATE) AS month, product_line,
  sum(order_amount) AS revenue, sum(marketing_spend) AS marketing_spend FROM chart GROUP BY ALL)"""


@register("chart_marketing_points", S.with_(S.CHART, _POINTS) + """
SELECT month, product_line, round(revenue, 6) AS revenue, round(marketing_spend, 6) AS marketing_spend FROM pts""")
def q_points(spark, sf):
    p = ch.marketing_points(orders(spark, sf))
    return p.select("month", "product_line", F.round("revenue", 6).alias("revenue"),
                    F.round("marketing_spend", 6).alias("marketing_spend"))


@register("chart_marketing_corr", S.with_(S.CHART, _POINTS) + """
SELECT round(corr(marketing_spend, revenue), 6) AS correlation,
       CASE WHEN corr(marketing_spend, revenue) >= 0.7 THEN 'strong' ELSE 'moderate' END AS strength FROM pts""")
def q_corr(spark, sf):
    return ch.marketing_corr(orders(spark, sf)).withColumn("correlation", r6("correlation"))


@register("chart_trend_line", S.with_(S.CHART, _POINTS) + """
SELECT CAST(i AS INTEGER) AS point, round(slope, 6) AS slope, round(intercept, 4) AS intercept,
       round(x0 + (x1 - x0) * i / 99, 4) AS x, round(slope * (x0 + (x1 - x0) * i / 99) + intercept, 4) AS y_hat
FROM (SELECT regr_slope(revenue, marketing_spend) AS slope, regr_intercept(revenue, marketing_spend) AS intercept,
             min(marketing_spend) AS x0, max(marketing_spend) AS x1 FROM pts), range(100) t(i)""")
def q_trend(spark, sf):
    t = ch.trend_line(orders(spark, sf))
    return t.select("point", r6("slope").alias("slope"), F.round("intercept", 4).alias("intercept"),
                    F.round("x", 4).alias("x"), F.round("y_hat", 4).alias("y_hat"))


@register("chart_marketing_outlier", S.with_(S.CHART, _POINTS) + """, fit AS (
  SELECT regr_slope(revenue, marketing_spend) AS m, regr_intercept(revenue, marketing_spend) AS b FROM pts)
SELECT month, product_line, round(revenue, 4) AS revenue, round(marketing_spend, 4) AS marketing_spend, round(residual, 4) AS residual
FROM (SELECT pts.*, revenue - (m * marketing_spend + b) AS residual FROM pts, fit)
ORDER BY residual, month, product_line LIMIT 1""")
def q_outlier(spark, sf):
    o = ch.marketing_outlier(orders(spark, sf))
    return o.select("month", "product_line", F.round("revenue", 4).alias("revenue"),
                    F.round("marketing_spend", 4).alias("marketing_spend"), F.round("residual", 4).alias("residual"))


_COMPACT = """CASE WHEN abs({v}) >= 1000000 THEN '$' || format('{{:.1f}}', {v} / 1000000) || 'M'
  WHEN abs({v}) >= 1000 THEN '$' || format('{{:.0f}}', {v} / 1000) || 'K' ELSE '$' || format('{{:.0f}}', {v}) END"""

_NOTES = S.with_(S.CHART, _MONTHLY.split(",\ntop3")[0] + ",\ntop3" + _MONTHLY.split(",\ntop3")[1], _QUARTERS, _POINTS) + f""",
rbp AS (SELECT product_line, sum(order_amount) AS revenue FROM chart
        WHERE order_date >= (SELECT max(order_date) FROM chart) - INTERVAL 90 DAY GROUP BY product_line),
lead AS (SELECT arg_max(product_line, (revenue, product_line)) AS p, max(revenue) AS r FROM rbp),
dip AS (SELECT arg_min(month, (s, month)) AS m FROM (SELECT month, sum(order_amount) AS s FROM mt GROUP BY month)),
bins AS (SELECT CASE WHEN order_amount >= 0 AND order_amount < 50 THEN 0 WHEN order_amount >= 50 AND order_amount < 100 THEN 1
   WHEN order_amount >= 100 AND order_amount < 150 THEN 2 WHEN order_amount >= 150 AND order_amount < 200 THEN 3
   WHEN order_amount >= 200 AND order_amount < 250 THEN 4 WHEN order_amount >= 250 AND order_amount < 300 THEN 5
   WHEN order_amount >= 300 AND order_amount <= 400 THEN 6 END AS bin, count(*) AS n FROM chart GROUP BY 1),
spine AS (SELECT * FROM (VALUES (0, 0.0, 50.0), (1, 50.0, 100.0), (2, 100.0, 150.0), (3, 150.0, 200.0), (4, 200.0, 250.0),
          (5, 250.0, 300.0), (6, 300.0, 400.0)) t(bin, lo, hi)),
peak AS (SELECT arg_min((lo + hi) / 2, (-coalesce(n, 0), spine.bin)) AS c FROM spine LEFT JOIN bins USING (bin)),
dom AS (SELECT arg_min(product_line, (-share, product_line)) AS p FROM comp WHERE quarter = (SELECT max(quarter) FROM comp)),
r AS (SELECT corr(marketing_spend, revenue) AS r FROM pts)
SELECT 'chart1' AS chart, '{ch.QUESTIONS["chart1"]}' AS question,
       (SELECT p || ' leads with ' || {_COMPACT.format(v="r")} || '.' FROM lead) AS key_insight, '{ch.ANNOTATIONS["chart1"]}' AS annotation
UNION ALL SELECT 'chart2', '{ch.QUESTIONS["chart2"]}',
       (SELECT 'The combined top-3 revenue trough occurs in ' || strftime(m, '%b %Y') || '.' FROM dip), '{ch.ANNOTATIONS["chart2"]}'
UNION ALL SELECT 'chart3', '{ch.QUESTIONS["chart3"]}',
       (SELECT 'Peak concentration is near $' || format('{{:.0f}}', c) || ' order values.' FROM peak), '{ch.ANNOTATIONS["chart3"]}'
UNION ALL SELECT 'chart4', '{ch.QUESTIONS["chart4"]}',
       (SELECT p || ' contributes the largest share in the latest quarter.' FROM dom), '{ch.ANNOTATIONS["chart4"]}'
UNION ALL SELECT 'chart5', '{ch.QUESTIONS["chart5"]}',
       (SELECT 'The relationship is ' || CASE WHEN r >= 0.7 THEN 'strong' ELSE 'moderate' END || ' with r=' || format('{{:.2f}}', r) || '.' FROM r),
       '{ch.ANNOTATIONS["chart5"]}'"""


@register("chart_notes", _NOTES)
def q_notes(spark, sf):
    return ch.chart_notes(orders(spark, sf))


@register("fmt_currency_compact", CH + """, agg AS (SELECT product_line, sum(order_amount) AS revenue FROM chart GROUP BY 1)
SELECT product_line, CASE WHEN abs(revenue) >= 1000000 THEN '$' || format('{:.1f}', revenue / 1000000) || 'M'
  WHEN abs(revenue) >= 1000 THEN '$' || format('{:.0f}', revenue / 1000) || 'K' ELSE '$' || format('{:.0f}', revenue) END AS label
FROM agg""")
def q_compact(spark, sf):
    a = orders(spark, sf).groupBy("product_line").agg(F.sum("order_amount").alias("revenue"))
    return a.select("product_line", fmt_currency_compact("revenue").alias("label"))
