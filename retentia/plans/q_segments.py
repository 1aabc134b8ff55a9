"""Segment and strategy queries (A12-A16, W1-W3, W13, K1, C9, display tables)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import segments as sg
from ..sources import adapters as ad
from ..sources.loaders import load_segment_data, load_segment_profile
from . import sql_adapters as S
from .registry import r6, register

SEG_SQL = S.with_(S.SEGMENTS)
PROF_SQL = S.with_(S.PROFILES)


def seg(spark, sf):
    return load_segment_data(ad.segments(spark, sf))


def prof(spark, sf):
    return load_segment_profile(ad.segment_profiles(spark, sf))


@register("load_segment_data", SEG_SQL + """
SELECT CAST(customer_id AS BIGINT) AS customer_id, customer_type, product, revenue, support_tickets, churn FROM segments
WHERE customer_type IS NOT NULL AND product IS NOT NULL AND revenue IS NOT NULL""")
def q_load_seg(spark, sf):
    return seg(spark, sf)


@register("load_segment_profile", PROF_SQL + "SELECT * FROM profiles")
def q_load_prof(spark, sf):
    return prof(spark, sf)


_METRICS = """m AS (SELECT customer_type, avg(churn) AS churn_rate, sum(revenue) AS total_revenue,
  count(customer_id) AS customer_count, avg(support_tickets) AS avg_support_tickets
  FROM segments WHERE customer_type IS NOT NULL GROUP BY customer_type)"""
_RANKED = """r AS (SELECT *, CAST(dense_rank() OVER (ORDER BY churn_rate DESC) AS DOUBLE) AS churn_rank,
  total_revenue / sum(total_revenue) OVER () * 100 AS revenue_contribution FROM m)"""


@register("segment_metrics", S.with_(S.SEGMENTS, _METRICS) + """
SELECT customer_type, round(churn_rate, 6) AS churn_rate, round(total_revenue, 2) AS total_revenue, customer_count,
       round(avg_support_tickets, 6) AS avg_support_tickets FROM m""")
def q_metrics(spark, sf):
    m = sg.segment_metrics(seg(spark, sf))
    return m.select("customer_type", r6("churn_rate").alias("churn_rate"),
                    F.round("total_revenue", 2).alias("total_revenue"), "customer_count",
                    r6("avg_support_tickets").alias("avg_support_tickets"))


def _ranked_out(df):
    return df.select("customer_type", r6("churn_rate").alias("churn_rate"), F.round("total_revenue", 2).alias("total_revenue"),
                     "customer_count", r6("avg_support_tickets").alias("avg_support_tickets"), "churn_rank",
                     r6("revenue_contribution").alias("revenue_contribution"))


_RANKED_SQL = """SELECT customer_type, round(churn_rate, 6) AS churn_rate, round(total_revenue, 2) AS total_revenue,
  customer_count, round(avg_support_tickets, 6) AS avg_support_tickets, churn_rank,
  round(revenue_contribution, 6) AS revenue_contribution FROM r"""


@register("segment_ranked", S.with_(S.SEGMENTS, _METRICS, _RANKED) + _RANKED_SQL)
def q_ranked(spark, sf):
    return _ranked_out(sg.segment_ranked(seg(spark, sf)))


@register("segment_worst_first", S.with_(S.SEGMENTS, _METRICS, _RANKED) + _RANKED_SQL)
def q_worst(spark, sf):
    return _ranked_out(sg.segment_worst_first(seg(spark, sf)))


@register("segment_product", SEG_SQL + """
SELECT customer_type, product, round(sum(revenue), 2) AS total_revenue, count(customer_id) AS customer_count
FROM segments WHERE customer_type IS NOT NULL AND product IS NOT NULL GROUP BY ALL""")
def q_seg_prod(spark, sf):
    return sg.segment_product(seg(spark, sf)).withColumn("total_revenue", F.round("total_revenue", 2))


@register("segment_product_unstacked", SEG_SQL + """
SELECT customer_type,
  round(coalesce(sum(revenue) FILTER (WHERE product = 'P0'), 0), 2) AS total_revenue_P0,
  round(coalesce(sum(revenue) FILTER (WHERE product = 'P1'), 0), 2) AS total_revenue_P1,
  round(coalesce(sum(revenue) FILTER (WHERE product = 'P2'), 0), 2) AS total_revenue_P2,
  count(customer_id) FILTER (WHERE product = 'P0') AS customer_count_P0,
  count(customer_id) FILTER (WHERE product = 'P1') AS customer_count_P1,
  count(customer_id) FILTER (WHERE product = 'P2') AS customer_count_P2
FROM segments WHERE customer_type IS NOT NULL AND product IS NOT NULL GROUP BY customer_type""")
def q_unstacked(spark, sf):
    u = sg.segment_product_unstacked(seg(spark, sf))
    return u.select(*[F.round(c, 2).alias(c) if c.startswith("total_revenue_") else F.col(c) for c in u.columns])


@register("segment_revenue_pivot", SEG_SQL + """
SELECT customer_type,
  round(coalesce(sum(revenue) FILTER (WHERE product = 'P0'), 0), 2) AS P0,
  round(coalesce(sum(revenue) FILTER (WHERE product = 'P1'), 0), 2) AS P1,
  round(coalesce(sum(revenue) FILTER (WHERE product = 'P2'), 0), 2) AS P2
FROM segments WHERE customer_type IS NOT NULL AND product IS NOT NULL GROUP BY customer_type""")
def q_pivot(spark, sf):
    p = sg.revenue_pivot(seg(spark, sf))
    return p.select("customer_type", *[F.round(c, 2).alias(c) for c in p.columns[1:]])


@register("segment_insights", S.with_(S.SEGMENTS, _METRICS, _RANKED) + """
SELECT customer_type AS segment, customer_count, format('{:.1f}', churn_rate * 100) || '%' AS churn_rate,
  '$' || format('{:.0f}', total_revenue) AS total_revenue,
  format('{:.1f}', revenue_contribution) || '%' AS revenue_contribution,
  CASE WHEN churn_rate > 0.10 THEN 'HIGH PRIORITY: Churn above 10%. Investigate pain points.'
       WHEN churn_rate < 0.02 THEN 'Healthy. Maintain current service level.'
       ELSE 'Monitor. No immediate action needed.' END AS action FROM r""")
def q_insights(spark, sf):
    return sg.segment_insights(seg(spark, sf))


_SMETRICS = """m AS (SELECT customer_type, avg(lifetime_value) AS avg_ltv, avg(churn) AS churn_rate,
  avg(support_tickets) AS avg_tickets, avg(retention_days) AS avg_retention, count(customer_id) AS count
  FROM profiles WHERE customer_type IS NOT NULL GROUP BY customer_type)"""
_SRANKED = """r AS (SELECT *, CAST(dense_rank() OVER (ORDER BY avg_ltv DESC) AS DOUBLE) AS ltv_rank,
  CAST(dense_rank() OVER (ORDER BY churn_rate ASC) AS DOUBLE) AS churn_rank,
  count / sum(count) OVER () * 100 AS segment_share_pct FROM m)"""


@register("strategy_metrics", S.with_(S.PROFILES, _SMETRICS) + """
SELECT customer_type, round(avg_ltv, 4) AS avg_ltv, round(churn_rate, 6) AS churn_rate, round(avg_tickets, 6) AS avg_tickets,
  round(avg_retention, 6) AS avg_retention, count FROM m""")
def q_smetrics(spark, sf):
    m = sg.strategy_metrics(prof(spark, sf))
    return m.select("customer_type", F.round("avg_ltv", 4).alias("avg_ltv"), r6("churn_rate").alias("churn_rate"),
                    r6("avg_tickets").alias("avg_tickets"), r6("avg_retention").alias("avg_retention"), "count")


@register("strategy_ranked", S.with_(S.PROFILES, _SMETRICS, _SRANKED) + """
SELECT customer_type, round(avg_ltv, 4) AS avg_ltv, ltv_rank, churn_rank, round(segment_share_pct, 6) AS segment_share_pct FROM r""")
def q_sranked(spark, sf):
    r = sg.strategy_ranked(prof(spark, sf))
    return r.select("customer_type", F.round("avg_ltv", 4).alias("avg_ltv"), "ltv_rank", "churn_rank",
                    r6("segment_share_pct").alias("segment_share_pct"))


@register("strategy_summary", S.with_(S.PROFILES, _SMETRICS, _SRANKED) + """
SELECT customer_type, round(avg_ltv, 4) AS avg_ltv, '$' || format('{:,.0f}', avg_ltv) AS avg_ltv_display, ltv_rank,
  round(churn_rate, 6) AS churn_rate, format('{:.1f}', churn_rate * 100) || '%' AS churn_rate_display, churn_rank,
  format('{:.2f}', avg_tickets) AS avg_tickets_display, format('{:.0f}', avg_retention) || ' days' AS avg_retention_display,
  count, format('{:.1f}', segment_share_pct) || '%' AS segment_share_display FROM r""")
def q_ssummary(spark, sf):
    s = sg.strategy_summary(prof(spark, sf))
    return s.withColumn("avg_ltv", F.round("avg_ltv", 4)).withColumn("churn_rate", r6("churn_rate"))


@register("strategy_performers", S.with_(S.PROFILES, _SMETRICS) + """
SELECT 'highest_value_segment' AS insight, arg_min(customer_type, (-avg_ltv, customer_type)) AS segment, 'avg_ltv' AS metric,
       round(max(avg_ltv), 4) AS value FROM m
UNION ALL
SELECT 'highest_churn_segment', arg_min(customer_type, (-churn_rate, -avg_ltv, customer_type)), 'churn_rate', round(max(churn_rate), 4) FROM m
UNION ALL
SELECT 'best_retention_segment', arg_min(customer_type, (-avg_retention, -avg_ltv, customer_type)), 'avg_retention', round(max(avg_retention), 4) FROM m""")
def q_performers(spark, sf):
    return sg.strategy_performers(prof(spark, sf)).withColumn("value", F.round("value", 4))


@register("strategy_narrative", S.with_(S.PROFILES, _SMETRICS, _SRANKED) + """
SELECT 0 AS line_no, 'SEGMENT STRATEGY SUMMARY:' AS line
UNION ALL
SELECT 2 * (row_number() OVER (ORDER BY avg_ltv DESC, customer_type) - 1) + 1,
  customer_type || ' (' || format('{:.1f}', segment_share_pct) || '% of base, $' || format('{:,.0f}', avg_ltv) || ' avg LTV, '
  || format('{:.1f}', churn_rate * 100) || '% churn):' FROM r
UNION ALL
SELECT 2 * (row_number() OVER (ORDER BY avg_ltv DESC, customer_type) - 1) + 2,
  '- Action: ' || CASE WHEN avg_ltv > 50000 AND churn_rate <= 0.05 THEN 'Maintain premium support and proactive retention programs'
                       WHEN churn_rate > 0.10 THEN 'Improve onboarding and guided support to reduce churn risk'
                       ELSE 'Scale self-service education while monitoring churn' END FROM r""")
def q_narrative(spark, sf):
    return sg.strategy_narrative(prof(spark, sf)).withColumn("line_no", F.col("line_no").cast("int"))


@register("heatmap_segments", S.with_(S.PROFILES, _SMETRICS) + """
SELECT customer_type, metric, round(value, 4) AS value FROM
  (SELECT customer_type, avg_ltv, churn_rate, avg_tickets, avg_retention FROM m)
  UNPIVOT (value FOR metric IN (avg_ltv, churn_rate, avg_tickets, avg_retention))""")
def q_heatmap(spark, sf):
    return sg.heatmap_segments(prof(spark, sf)).withColumn("value", F.round("value", 4))
