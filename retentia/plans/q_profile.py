"""Profiling (Q1-Q8) and dictionary (G1, G3) queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import dictionary, profile
from ..sources import adapters as ad
from . import sql_adapters as S
from .registry import register

LI_NUM = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]
LI_CAT = ["l_returnflag", "l_linestatus"]
LI_ALL = LI_NUM[:4] + ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]
VIEWER_COLS = ["viewer_id", "user_name", "country", "subscription_plan", "monthly_fee", "content_id", "watch_date",
               "watch_duration_minutes", "completion_rate", "viewing_frequency_per_week", "subscription_status",
               "churn", "order_ref"]


def li(spark, sf):
    return ad.table(spark, sf, "lineitem")


@register("profile_shape", """
SELECT 'lineitem' AS dataset, count(*) AS total_rows, CAST(11 AS BIGINT) AS total_columns,
 'l_orderkey,l_partkey,l_suppkey,l_linenumber,l_quantity,l_extendedprice,l_discount,l_tax,l_returnflag,l_linestatus,l_shipdate' AS columns
FROM lineitem
UNION ALL
SELECT 'orders', count(*), 6, 'o_orderkey,o_custkey,o_orderstatus,o_totalprice,o_orderdate,o_orderpriority' FROM orders
UNION ALL
SELECT 'customer', count(*), 5, 'c_custkey,c_name,c_nationkey,c_acctbal,c_mktsegment' FROM customer""")
def q_shape(spark, sf):
    return (profile.profile_shape(li(spark, sf), "lineitem")
            .unionByName(profile.profile_shape(ad.table(spark, sf, "orders"), "orders"))
            .unionByName(profile.profile_shape(ad.table(spark, sf, "customer"), "customer")))


def _completeness_sql(src, cols):
    n = len(cols)
    nulls = " + ".join(f"count(*) FILTER (WHERE {c} IS NULL)" for c in cols)
    parts = [f"""SELECT '{c}' AS "column", count(*) FILTER (WHERE {c} IS NULL) AS null_count,
  round(count(*) FILTER (WHERE {c} IS NULL) / greatest(count(*), 1) * 100, 2) AS null_percentage,
  count(*) FILTER (WHERE {c} IS NULL) = 0 AS is_complete,
  (SELECT round((count(*) * {n} - ({nulls})) / greatest(count(*) * {n}, 1) * 100, 2) FROM {src}) AS overall_completeness_pct
  FROM {src}""" for c in cols]
    return "\nUNION ALL\n".join(parts)


@register("profile_completeness", S.with_(S.VIEWERS) + _completeness_sql("viewers", VIEWER_COLS))
def q_completeness(spark, sf):
    return profile.profile_completeness(ad.viewers(spark, sf))


@register("profile_uniqueness", f"""
SELECT CAST(sum(n - 1) AS BIGINT) AS exact_duplicate_rows, round(sum(n - 1) / greatest(sum(n), 1) * 100, 2) AS exact_duplicate_pct,
       sum(n - 1) = 0 AS is_unique, 'l_orderkey' AS primary_key,
       (SELECT CAST(sum(m - 1) AS BIGINT) FROM (SELECT count(*) AS m FROM lineitem GROUP BY l_orderkey)) AS primary_key_duplicates,
       (SELECT sum(m - 1) = 0 FROM (SELECT count(*) AS m FROM lineitem GROUP BY l_orderkey)) AS primary_key_unique
FROM (SELECT count(*) AS n FROM lineitem GROUP BY {", ".join(LI_ALL)})""")
def q_uniqueness(spark, sf):
    return profile.profile_uniqueness(li(spark, sf), "l_orderkey")


def _numeric_sql(src, cols):
    parts = []
    for c in cols:
        x = f"CAST({c} AS DOUBLE)"
        parts.append(f"""SELECT '{c}' AS "column", count({x}) AS count, round(avg({x}), 4) AS mean,
  CASE WHEN count({x}) > 1 THEN round(stddev_samp({x}), 4) ELSE 0.0 END AS std,
  round(min({x}), 4) AS min, round(quantile_cont({x}, 0.25), 4) AS q25, round(quantile_cont({x}, 0.5), 4) AS median,
  round(quantile_cont({x}, 0.75), 4) AS q75, round(max({x}), 4) AS max,
  round(quantile_cont({x}, 0.75) - quantile_cont({x}, 0.25), 4) AS iqr,
  CASE WHEN count({x}) <= 2 THEN 0.0 ELSE round(coalesce(skewness({x}), 0.0), 4) END AS skewness,
  (SELECT count(*) FROM {src}, (SELECT quantile_cont({x}, 0.25) AS a, quantile_cont({x}, 0.75) AS b FROM {src}) f
   WHERE {x} < f.a - 1.5 * (f.b - f.a) OR {x} > f.b + 1.5 * (f.b - f.a)) AS outlier_count
  FROM {src}""")
    body = "\nUNION ALL\n".join(parts)
    return body, f"SELECT *, round(outlier_count / greatest(count, 1) * 100, 2) AS outlier_pct FROM ({body})"


@register("profile_numeric", _numeric_sql("lineitem", LI_NUM)[1])
def q_numeric(spark, sf):
    return profile.profile_numeric(li(spark, sf))


@register("profile_outliers", f"""
SELECT "column", round(q25 - 1.5 * iqr, 5) AS lower_bound, round(q75 + 1.5 * iqr, 5) AS upper_bound,
       outlier_count, outlier_pct FROM ({_numeric_sql("lineitem", LI_NUM)[1]})""")
def q_outliers(spark, sf):
    return profile.profile_outliers(li(spark, sf))


def _categorical_sql(src, cols):
    unions = " UNION ALL ".join(f"""SELECT '{c}' AS "column", CAST({c} AS VARCHAR) AS v FROM {src}""" for c in cols)
    return f"""WITH l AS ({unions}),
counts AS (SELECT "column", v, count(*) AS n FROM l WHERE v IS NOT NULL GROUP BY ALL),
summary AS (SELECT "column", sum(n) AS total_non_null, count(*) AS unique_values FROM counts GROUP BY 1),
top AS (SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY n DESC, v) AS top_rank FROM counts)
SELECT s."column", CAST(s.total_non_null AS BIGINT) AS total_non_null, s.unique_values,
       round(s.unique_values / greatest((SELECT count(*) FROM {src}), 1) * 100, 2) AS cardinality_pct,
       CAST(t.top_rank AS INTEGER) AS top_rank, t.v AS top_value, t.n AS top_count
FROM summary s LEFT JOIN top t ON s."column" = t."column" AND t.top_rank <= 5"""


@register("profile_categorical", _categorical_sql("lineitem", LI_CAT))
def q_categorical(spark, sf):
    return profile.profile_categorical(li(spark, sf))


def _quality_sql():
    cols = VIEWER_COLS
    n = len(cols)
    nulls = " + ".join(f"count(*) FILTER (WHERE {c} IS NULL)" for c in cols)
    hi = " || ".join(
        f"(CASE WHEN count(*) FILTER (WHERE {c} IS NULL) / greatest(count(*), 1) > 0.2 THEN '|''{c}''' ELSE '' END)"
        for c in cols)
    return S.with_(S.VIEWERS, f"""agg AS (SELECT count(*) AS rows, {nulls} AS miss, {hi} AS hi,
  count(*) FILTER (WHERE watch_duration_minutes < 0) AS neg FROM viewers)""",
                   f"""dup AS (SELECT coalesce(sum(n - 1), 0) AS d FROM (SELECT count(*) AS n FROM viewers GROUP BY {", ".join(VIEWER_COLS)}))""",
                   f"""s AS (SELECT agg.*, dup.d,
  greatest(0.0, 100 - miss / greatest(rows * {n}, 1) * 100) AS comp, greatest(0.0, 100 - d / greatest(rows, 1) * 100) AS uniq,
  list_filter([CASE WHEN hi <> '' THEN 'High missingness (>20%) detected in: [' || replace(substr(hi, 2), '|', ', ') || ']' END,
               CASE WHEN neg > 0 THEN 'Negative values found in non-negative domain column ''watch_duration_minutes''' END],
              lambda x: x IS NOT NULL) AS issues
  FROM agg, dup)""") + """
SELECT round(greatest(0.0, comp * 0.5 + uniq * 0.3 - len(issues) * 10), 1) AS overall_quality_score,
  CASE WHEN round(greatest(0.0, comp * 0.5 + uniq * 0.3 - len(issues) * 10), 1) >= 90 THEN 'EXCELLENT'
       WHEN round(greatest(0.0, comp * 0.5 + uniq * 0.3 - len(issues) * 10), 1) >= 75 THEN 'GOOD' ELSE 'NEEDS_ATTENTION' END AS quality_status,
  round(comp, 1) AS completeness_score, round(uniq, 1) AS uniqueness_score,
  array_to_string(issues, ' | ') AS critical_issues,
  CASE WHEN d > 0 THEN 'Found ' || d || ' exact duplicate rows (' || round(d / rows * 100, 1) || '%)' ELSE '' END AS warnings
FROM s"""


@register("profile_quality", _quality_sql())
def q_quality(spark, sf):
    return profile.assess_quality(ad.viewers(spark, sf))


@register("profile_report")
def q_report(spark, sf):
    return profile.dataset_profile(li(spark, sf), "lineitem", "l_orderkey")


def _rules_sql():
    rules = [
        ("viewer_id", "not_null", "count(*) FILTER (WHERE viewer_id IS NULL)"),
        ("user_name", "not_null", "count(*) FILTER (WHERE user_name IS NULL)"),
        ("country", "not_null", "count(*) FILTER (WHERE country IS NULL)"),
        ("subscription_plan", "not_null", "count(*) FILTER (WHERE subscription_plan IS NULL)"),
        ("subscription_plan", "allowed_values",
         "count(*) FILTER (WHERE subscription_plan IS NOT NULL AND subscription_plan NOT IN ('Basic', 'Standard', 'Premium'))"),
        ("monthly_fee", "not_null", "count(*) FILTER (WHERE monthly_fee IS NULL)"),
        ("monthly_fee", "min_value", "count(*) FILTER (WHERE monthly_fee < 0.0)"),
        ("content_id", "not_null", "count(*) FILTER (WHERE content_id IS NULL)"),
        ("watch_date", "not_null", "count(*) FILTER (WHERE watch_date IS NULL)"),
        ("watch_duration_minutes", "not_null", "count(*) FILTER (WHERE watch_duration_minutes IS NULL)"),
        ("watch_duration_minutes", "min_value", "count(*) FILTER (WHERE watch_duration_minutes < 0.0)"),
        ("completion_rate", "not_null", "count(*) FILTER (WHERE completion_rate IS NULL)"),
        ("completion_rate", "min_value", "count(*) FILTER (WHERE completion_rate < 0.0)"),
        ("completion_rate", "max_value", "count(*) FILTER (WHERE completion_rate > 1.0)"),
        ("viewing_frequency_per_week", "not_null", "count(*) FILTER (WHERE viewing_frequency_per_week IS NULL)"),
        ("viewing_frequency_per_week", "min_value", "count(*) FILTER (WHERE viewing_frequency_per_week < 0)"),
        ("viewing_frequency_per_week", "max_value", "count(*) FILTER (WHERE viewing_frequency_per_week > 7)"),
        ("subscription_status", "not_null", "count(*) FILTER (WHERE subscription_status IS NULL)"),
        ("subscription_status", "allowed_values",
         "count(*) FILTER (WHERE subscription_status IS NOT NULL AND subscription_status NOT IN ('Active', 'Paused', 'Cancelled'))"),
        ("churn", "not_null", "count(*) FILTER (WHERE churn IS NULL)"),
        ("churn", "allowed_values", "count(*) FILTER (WHERE churn IS NOT NULL AND CAST(churn AS VARCHAR) NOT IN ('0', '1'))"),
    ]
    parts = [f"""SELECT '{c}' AS "column", '{r}' AS rule, CAST({e} AS BIGINT) AS violations FROM viewers""" for c, r, e in rules]
    parts.append("""SELECT 'viewer_id', 'primary_key_unique', CAST(coalesce(sum(n - 1), 0) AS BIGINT)
  FROM (SELECT count(*) AS n FROM viewers GROUP BY viewer_id)""")
    return S.with_(S.VIEWERS) + "\nUNION ALL\n".join(parts)


@register("dict_rule_violations", _rules_sql())
def q_rules(spark, sf):
    return dictionary.rule_violations(ad.viewers(spark, sf))


# The dictionary's fields beside the viewer columns that hold data.
_DICT = "d(field, domain) AS (VALUES " + ", ".join(f"('{f[0]}', '{f[1]}')" for f in dictionary.FIELDS) + ")"
_SEEN = "o AS (" + " UNION ALL ".join(f"SELECT '{c}' AS field FROM viewers HAVING count({c}) > 0" for c in VIEWER_COLS) + ")"


@register("dict_coverage", S.with_(S.VIEWERS, _DICT, _SEEN) + """
SELECT domain, CAST(count(*) AS INTEGER) AS total_domain_fields, CAST(count(o.field) AS INTEGER) AS present_in_dataset,
  round(count(o.field) * 100.0 / count(*), 1)::DOUBLE AS coverage_pct, (SELECT count(*) FROM o) AS total_dataset_columns,
  (SELECT string_agg(field, ', ' ORDER BY field) FROM o WHERE field IN (SELECT field FROM d)) AS matched_columns,
  (SELECT coalesce(string_agg(field, ', ' ORDER BY field), '') FROM o WHERE field NOT IN (SELECT field FROM d)) AS unmatched_dataset_columns,
  (SELECT count(*) FROM d WHERE field NOT IN (SELECT field FROM o)) AS missing_standard_fields_count
FROM d LEFT JOIN o USING (field) GROUP BY domain""")
def q_coverage(spark, sf):
    return dictionary.schema_coverage(ad.viewers(spark, sf), observed=True).withColumn(
        "total_domain_fields", F.col("total_domain_fields").cast("int")).withColumn(
        "present_in_dataset", F.col("present_in_dataset").cast("int"))
