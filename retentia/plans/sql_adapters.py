"""The adapters of ``sources/adapters.py`` as DuckDB SQL CTEs, for the oracle queries."""

TRANSACTIONS = """transactions AS (
  SELECT o.o_orderkey AS row_id, o.o_custkey AS customer_id,
         CAST(o.o_orderdate AS DATE) AS transaction_date, o.o_totalprice AS amount,
         c.c_mktsegment AS customer_type, o.o_orderpriority AS product,
         CASE o.o_orderstatus WHEN 'F' THEN 'SUCCESS' WHEN 'O' THEN 'success' ELSE 'failed' END AS payment_status,
         20 + o.o_custkey % 70 AS acquisition_cost
  FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey)"""

SEGMENTS = """segments AS (
  SELECT c_custkey AS customer_id, c_mktsegment AS customer_type,
         'P' || CAST(c_nationkey % 3 AS VARCHAR) AS product, c_acctbal AS revenue,
         c_custkey % 9 AS support_tickets, CASE WHEN c_custkey % 5 = 0 THEN 1 ELSE 0 END AS churn
  FROM customer)"""

PROFILES = """profiles AS (
  SELECT c_custkey AS customer_id, c_mktsegment AS customer_type, c_acctbal * 10 AS lifetime_value,
         CASE WHEN c_custkey % 5 = 0 THEN 1 ELSE 0 END AS churn,
         c_custkey % 9 AS support_tickets, c_custkey % 700 AS retention_days
  FROM customer)"""

DAILY = """daily AS (
  SELECT CAST(o_orderdate AS DATE) AS date, sum(o_totalprice) AS revenue, count(*) AS orders
  FROM orders GROUP BY 1)"""

CORR = """corr_in AS (
  SELECT p.customer_id, p.engagement, p.transactions_per_month, s.support_tickets, s.churn
  FROM (SELECT o_custkey AS customer_id, sum(o_totalprice) AS engagement, count(*) AS transactions_per_month
        FROM orders GROUP BY 1) p
  JOIN (SELECT c_custkey AS customer_id, c_custkey % 9 AS support_tickets,
               CASE WHEN c_custkey % 5 = 0 THEN 1 ELSE 0 END AS churn FROM customer) s
    ON p.customer_id = s.customer_id)"""

MISSING = """missing AS (
  SELECT o_orderkey,
         CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE o_custkey END AS o_custkey,
         o_orderstatus,
         CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_totalprice END AS o_totalprice,
         CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS o_orderdate,
         CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderpriority END AS o_orderpriority
  FROM orders)"""

_PRICE2 = "format('{:,.2f}', o_totalprice)"
UNSTD = f"""unstd AS (
  SELECT o_orderkey AS row_id, CAST(o_orderkey AS VARCHAR) AS order_id,
         CASE WHEN o_orderkey % 19 = 0 THEN 'not-a-date'
              WHEN o_orderkey % 4 = 1 THEN CAST(year(o_orderdate) AS VARCHAR) || '-' || CAST(month(o_orderdate) AS VARCHAR) || '-' || CAST(day(o_orderdate) AS VARCHAR)
              WHEN o_orderkey % 4 = 2 THEN ' ' || strftime(o_orderdate, '%Y-%m-%d') || ' '
              ELSE strftime(o_orderdate, '%Y-%m-%d') END AS order_date,
         CASE WHEN o_orderkey % 23 = 0 THEN 'n/a'
              WHEN o_orderkey % 3 = 0 THEN '  $' || {_PRICE2} || ' '
              WHEN o_orderkey % 3 = 1 THEN {_PRICE2} || ' USD'
              ELSE '$' || {_PRICE2} END AS total_price,
         CASE o_orderkey % 6 WHEN 0 THEN 'T' WHEN 1 THEN 'yes' WHEN 2 THEN '0' WHEN 3 THEN 'maybe'
              WHEN 4 THEN ' False ' ELSE 'n' END AS auto_renew,
         CASE WHEN o_orderkey % 3 = 0 THEN '  ' || lower(o_orderpriority) || ' '
              WHEN o_orderkey % 3 = 1 THEN upper(o_orderpriority) ELSE o_orderpriority END AS priority,
         o_orderstatus AS status
  FROM orders)"""

DUPS = """dups AS (
  SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, CAST(o_orderdate AS DATE) AS o_orderdate,
         o_orderpriority, o_orderkey * 3 AS row_id FROM orders
  UNION ALL
  SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, CAST(o_orderdate AS DATE),
         o_orderpriority, o_orderkey * 3 + 1 FROM orders WHERE o_orderkey % 5 = 0
  UNION ALL
  SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, CAST(o_orderdate AS DATE),
         CAST(NULL AS VARCHAR), o_orderkey * 3 + 2 FROM orders WHERE o_orderkey % 9 = 0)"""

SAMPLE = """sample AS (
  SELECT o_custkey AS customer_id, 'Customer#' || CAST(o_custkey AS VARCHAR) AS customer_name,
         o_totalprice AS transaction_amount, CAST(o_orderdate AS DATE) AS transaction_date
  FROM orders)"""

CHART = """chart AS (
  SELECT CAST(l_shipdate AS DATE) AS order_date, l_returnflag || l_linestatus AS product_line,
         l_extendedprice / 300 AS order_amount, l_extendedprice * l_discount / 300 AS marketing_spend
  FROM lineitem)"""

VIEWERS = """viewers AS (
  SELECT 'V' || CAST(o.o_custkey AS VARCHAR) AS viewer_id, c.c_name AS user_name,
         'N' || CAST(c.c_nationkey AS VARCHAR) AS country,
         CASE o.o_orderpriority WHEN '1-URGENT' THEN 'Premium' WHEN '2-HIGH' THEN 'Standard'
              WHEN '3-MEDIUM' THEN 'Basic' WHEN '4-NOT SPECIFIED' THEN 'basic' ELSE NULL END AS subscription_plan,
         CAST(c.c_acctbal / 100 AS DOUBLE) AS monthly_fee,
         'C' || CAST(o.o_orderkey % 97 AS VARCHAR) AS content_id,
         CAST(o.o_orderdate AS DATE) AS watch_date,
         CASE WHEN o.o_orderkey % 29 = 0 THEN NULL ELSE o.o_totalprice / 1000 - 50 END AS watch_duration_minutes,
         (o.o_orderkey % 120) / 100.0 AS completion_rate,
         o.o_orderkey % 9 AS viewing_frequency_per_week,
         CASE o.o_orderstatus WHEN 'F' THEN 'Cancelled' WHEN 'O' THEN 'Active' ELSE 'Paused' END AS subscription_status,
         CAST(o.o_custkey % 5 = 0 AS INTEGER) AS churn,
         o.o_orderkey AS order_ref
  FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey)"""


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"
