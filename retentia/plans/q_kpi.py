"""KPI queries (A1-A11, J2, J3, S9) over the ``transactions`` adapter."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import kpi
from ..sources import adapters as ad
from ..sources.loaders import load_transactions
from . import sql_adapters as S
from .registry import r6, register

T = S.with_(S.TRANSACTIONS)
ANCHOR = "(SELECT max(transaction_date) FROM transactions)"


def _round_kpi(c):
    """Money totals to cents, everything else to 6 dp (sums of large magnitude differ
    in their last bits between engines)."""
    return F.when(F.col("kpi") == "total_revenue", F.round(c, 2)).otherwise(F.round(c, 6))


def tx(spark, sf):
    return load_transactions(ad.transactions(spark, sf))


@register("load_transactions", T + """
SELECT row_id, customer_id, transaction_date, amount, customer_type, product, payment_status,
       acquisition_cost FROM transactions
WHERE customer_id IS NOT NULL AND transaction_date IS NOT NULL AND amount IS NOT NULL
  AND acquisition_cost IS NOT NULL""")
def q_load_transactions(spark, sf):
    return tx(spark, sf)


@register("kpi_reference_date", T + "SELECT max(transaction_date) AS reference_date FROM transactions")
def q_reference_date(spark, sf):
    return kpi.reference_date_frame(tx(spark, sf))


@register("kpi_mau", T + f"""
SELECT CAST(count(DISTINCT customer_id) AS BIGINT) AS monthly_active_users FROM transactions
WHERE transaction_date >= {ANCHOR} - INTERVAL 30 DAY""")
def q_mau(spark, sf):
    return kpi.mau(tx(spark, sf))


@register("kpi_revenue_per_customer", T + """
SELECT round(coalesce(sum(amount) / nullif(count(DISTINCT customer_id), 0), 0.0), 6) AS revenue_per_customer
FROM transactions""")
def q_rpc(spark, sf):
    return kpi.revenue_per_customer(tx(spark, sf)).select(r6("revenue_per_customer").alias("revenue_per_customer"))


_P = f"""p AS (
  SELECT customer_id,
         bool_or(transaction_date BETWEEN {ANCHOR} - INTERVAL 60 DAY AND {ANCHOR} - INTERVAL 30 DAY) AS p1,
         bool_or(transaction_date BETWEEN {ANCHOR} - INTERVAL 30 DAY AND {ANCHOR}) AS p2
  FROM transactions GROUP BY customer_id)"""


@register("kpi_churn_rate", S.with_(S.TRANSACTIONS, _P) + """
SELECT round(coalesce(CAST(count(*) FILTER (WHERE p1 AND NOT p2) AS DOUBLE)
                      / nullif(count(*) FILTER (WHERE p1), 0), 0.0), 6) AS churn_rate FROM p""")
def q_churn(spark, sf):
    return kpi.churn_rate(tx(spark, sf)).select(r6("churn_rate").alias("churn_rate"))


@register("kpi_churned_customers", S.with_(S.TRANSACTIONS, _P) + """
SELECT customer_id FROM p WHERE p1 AND NOT p2""")
def q_churned(spark, sf):
    return kpi.churned_customers(tx(spark, sf))


@register("kpi_payment_success", T + """
SELECT round(CAST(count(*) FILTER (WHERE lower(payment_status) = 'success') AS DOUBLE) / count(*), 6)
       AS payment_success_rate FROM transactions""")
def q_success(spark, sf):
    return kpi.payment_success_rate(tx(spark, sf)).select(r6("payment_success_rate").alias("payment_success_rate"))


@register("kpi_cac", T + """
SELECT round(avg(cost), 6) AS customer_acquisition_cost FROM (
  SELECT customer_id, arg_min(acquisition_cost, row_id) AS cost FROM transactions
  WHERE acquisition_cost IS NOT NULL GROUP BY customer_id)""")
def q_cac(spark, sf):
    return kpi.customer_acquisition_cost(tx(spark, sf)).select(
        r6("customer_acquisition_cost").alias("customer_acquisition_cost"))


@register("kpi_total_revenue", T + "SELECT round(sum(amount), 2) AS total_revenue FROM transactions")
def q_total(spark, sf):
    return kpi.total_revenue(tx(spark, sf)).select(F.round("total_revenue", 2).alias("total_revenue"))


_KPI_VALUES = f"""kv AS (
  SELECT * FROM (
    SELECT
      CAST((SELECT count(DISTINCT customer_id) FROM transactions
            WHERE transaction_date >= {ANCHOR} - INTERVAL 30 DAY) AS DOUBLE) AS monthly_active_users,
      (SELECT sum(amount) / count(DISTINCT customer_id) FROM transactions) AS revenue_per_customer,
      (SELECT coalesce(CAST(count(*) FILTER (WHERE p1 AND NOT p2) AS DOUBLE) / nullif(count(*) FILTER (WHERE p1), 0), 0.0) FROM p) AS churn_rate,
      (SELECT CAST(count(*) FILTER (WHERE lower(payment_status) = 'success') AS DOUBLE) / count(*) FROM transactions) AS payment_success_rate,
      (SELECT avg(c) FROM (SELECT arg_min(acquisition_cost, row_id) AS c FROM transactions GROUP BY customer_id)) AS customer_acquisition_cost,
      (SELECT sum(amount) FROM transactions) AS total_revenue
  ) UNPIVOT (value FOR kpi IN (monthly_active_users, revenue_per_customer, churn_rate,
                               payment_success_rate, customer_acquisition_cost, total_revenue)))"""

_FMT = """CASE WHEN kpi = 'monthly_active_users' THEN format('{:,}', CAST(value AS BIGINT))
            WHEN kpi IN ('churn_rate', 'payment_success_rate') THEN format('{:.1f}', value * 100) || '%'
            ELSE '$' || format('{:,.2f}', value) END"""


@register("kpi_all", S.with_(S.TRANSACTIONS, _P, _KPI_VALUES) + f"""
SELECT kpi, CASE WHEN kpi = 'total_revenue' THEN round(value, 2) ELSE round(value, 6) END AS value,
       {_FMT} AS formatted FROM kv""")
def q_kpi_all(spark, sf):
    k = kpi.compute_all_kpis(tx(spark, sf))
    return k.select("kpi", _round_kpi("value").alias("value"), "formatted")


_TARGETS = """targets AS (SELECT * FROM (VALUES
  ('monthly_active_users', 9.0, 12.0), ('revenue_per_customer', 120.0, 170.0), ('churn_rate', 0.0, 0.35),
  ('payment_success_rate', 0.9, 1.0), ('customer_acquisition_cost', 30.0, 55.0), ('total_revenue', 1500.0, 2500.0)
) t(kpi, min, max))"""

_VALIDATION = f"""validation AS (
  SELECT t.kpi, kv.value AS actual, {_FMT.replace('kpi', 't.kpi').replace('value', 'kv.value')} AS formatted,
         CAST(t.min AS DOUBLE) AS target_min, CAST(t.max AS DOUBLE) AS target_max,
         CASE WHEN t.min <= kv.value AND kv.value <= t.max THEN 'PASS' ELSE 'ALERT' END AS status
  FROM targets t JOIN kv ON t.kpi = kv.kpi)"""


@register("kpi_target_validation", S.with_(S.TRANSACTIONS, _P, _KPI_VALUES, _TARGETS, _VALIDATION) + """
SELECT kpi, CASE WHEN kpi = 'total_revenue' THEN round(actual, 2) ELSE round(actual, 6) END AS actual,
       formatted, target_min, target_max, status FROM validation""")
def q_validation(spark, sf):
    t = tx(spark, sf)
    v = kpi.validate_against_targets(kpi.compute_all_kpis(t), kpi.default_targets(spark))
    return v.select("kpi", _round_kpi("actual").alias("actual"), "formatted", "target_min", "target_max", "status")


@register("kpi_summary", S.with_(S.TRANSACTIONS, _P, _KPI_VALUES, _TARGETS, _VALIDATION) + """
SELECT CAST(count(*) FILTER (WHERE status = 'ALERT') AS BIGINT) AS alerts, CAST(count(*) AS BIGINT) AS kpis,
       CASE WHEN count(*) FILTER (WHERE status = 'ALERT') > 0
            THEN 'ALERT: ' || CAST(count(*) FILTER (WHERE status = 'ALERT') AS VARCHAR) || ' KPI(s) outside target range'
            ELSE 'PASS: all ' || CAST(count(*) AS VARCHAR) || ' KPI(s) within target range' END AS summary
FROM validation""")
def q_summary(spark, sf):
    t = tx(spark, sf)
    v = kpi.validate_against_targets(kpi.compute_all_kpis(t), kpi.default_targets(spark))
    return kpi.validation_summary(v)


@register("kpi_revenue_decomposition", T + """, parts AS (
  SELECT 'segment' AS breakdown, customer_type AS member, sum(amount) AS revenue FROM transactions
  WHERE customer_type IS NOT NULL GROUP BY customer_type
  UNION ALL
  SELECT 'product', product, sum(amount) FROM transactions WHERE product IS NOT NULL GROUP BY product
  UNION ALL
  SELECT 'total', NULL, sum(amount) FROM transactions)
SELECT breakdown, member, round(revenue, 2) AS revenue,
  CAST(row_number() OVER (PARTITION BY breakdown ORDER BY revenue DESC, member) AS INTEGER) AS rank,
  abs(sum(revenue) OVER (PARTITION BY breakdown) - (SELECT sum(amount) FROM transactions))
    <= 1e-9 * greatest(1, abs((SELECT sum(amount) FROM transactions))) AS sum_matches_total
FROM parts""")
def q_decomposition(spark, sf):
    d = kpi.decompose_total_revenue(tx(spark, sf))
    return d.select("breakdown", "member", F.round("revenue", 2).alias("revenue"), "rank", "sum_matches_total")
