"""Missing-value queries (M1-M9, P1) over the ``missing`` adapter."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import dedup, missing
from ..session import materialize
from ..sources import adapters as ad
from . import sql_adapters as S
from .registry import register

M = S.with_(S.MISSING)
COLS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]
DTYPES = ["bigint", "bigint", "string", "double", "date", "string"]
PLAN = dict(critical_identifiers=["o_custkey"], time_series_cols=["o_orderdate", "o_totalprice"],
            date_sort_col="o_orderdate", numerical_median_cols=["o_totalprice"],
            categorical_mode_cols=["o_orderpriority", "o_orderstatus"], order_col="o_orderkey")


def raw(spark, sf):
    return ad.missing_orders(spark, sf)


def handled(spark, sf):
    return missing.handle_missing_values(raw(spark, sf), **PLAN)


def _detect_sql(src):
    parts = [f"""SELECT '{c}' AS "column", {i} AS position, count(*) FILTER (WHERE {c} IS NULL) AS null_count,
       round(count(*) FILTER (WHERE {c} IS NULL) / greatest(count(*), 1) * 100, 2) AS null_percentage,
       count(*) FILTER (WHERE {c} IS NULL) > 0 AS has_missing, '{t}' AS dtype FROM {src}"""
             for i, (c, t) in enumerate(zip(COLS, DTYPES))]
    return "\nUNION ALL\n".join(parts)


@register("missing_detect", M + _detect_sql("missing"))
def q_detect(spark, sf):
    return missing.detect_missing(raw(spark, sf)).withColumn("position", F.col("position").cast("int"))


@register("missing_drop_critical", M + "SELECT * FROM missing WHERE o_custkey IS NOT NULL")
def q_drop(spark, sf):
    return raw(spark, sf).dropna(subset=["o_custkey"])


_FFILL = """coalesce(last_value({c} IGNORE NULLS) OVER (ORDER BY o_orderdate NULLS LAST, o_orderkey
                 ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
         (SELECT arg_min({c}, {{k}}) FROM {src} WHERE {c} IS NOT NULL))"""
_KEY = "(o_orderdate IS NULL, o_orderdate, o_orderkey)"


def _ffill(c, src):
    return _FFILL.format(c=c, src=src).replace("{k}", _KEY)


@register("missing_ffill_bfill", M + f"""
SELECT o_orderkey, o_custkey, o_orderstatus, {_ffill('o_totalprice', 'missing')} AS o_totalprice,
       {_ffill('o_orderdate', 'missing')} AS o_orderdate, o_orderpriority FROM missing""")
def q_ffill(spark, sf):
    out, _ = missing.handle_missing_values(raw(spark, sf), time_series_cols=["o_orderdate", "o_totalprice"],
                                           date_sort_col="o_orderdate", order_col="o_orderkey")
    return out


@register("missing_median_impute", M + """
SELECT o_orderkey, o_custkey, o_orderstatus,
       coalesce(o_totalprice, (SELECT median(o_totalprice) FROM missing)) AS o_totalprice,
       o_orderdate, o_orderpriority FROM missing""")
def q_median(spark, sf):
    out, _ = missing.handle_missing_values(raw(spark, sf), numerical_median_cols=["o_totalprice"],
                                           order_col="o_orderkey")
    return out


_MODE = "(SELECT {c} FROM {src} WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1)"


@register("missing_mode_impute", M + f"""
SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate,
       coalesce(o_orderpriority, {_MODE.format(c='o_orderpriority', src='missing')}) AS o_orderpriority FROM missing""")
def q_mode(spark, sf):
    out, _ = missing.handle_missing_values(raw(spark, sf), categorical_mode_cols=["o_orderpriority"],
                                           order_col="o_orderkey")
    return out


_CHAIN = S.with_(S.MISSING, """d AS (SELECT * FROM missing WHERE o_custkey IS NOT NULL)""",
                 f"""f AS (SELECT o_orderkey, o_custkey, o_orderstatus, {_ffill('o_totalprice', 'd')} AS o_totalprice,
       {_ffill('o_orderdate', 'd')} AS o_orderdate, o_orderpriority FROM d)""",
                 """m AS (SELECT o_orderkey, o_custkey, o_orderstatus,
       coalesce(o_totalprice, (SELECT median(o_totalprice) FROM f)) AS o_totalprice, o_orderdate, o_orderpriority FROM f)""",
                 f"""c AS (SELECT o_orderkey, o_custkey,
       coalesce(o_orderstatus, {_MODE.format(c='o_orderstatus', src='m')}) AS o_orderstatus, o_totalprice, o_orderdate,
       coalesce(o_orderpriority, {_MODE.format(c='o_orderpriority', src='m')}) AS o_orderpriority FROM m)""")


@register("missing_handle", _CHAIN + "SELECT * FROM c")
def q_handle(spark, sf):
    return handled(spark, sf)[0]


_R_DROP = ("'Dropped ' || n || ' rows with missing critical identifier ''o_custkey''. "
           "Primary keys cannot be reliably imputed without introducing artificial identity collisions.'")


def _r_ffill(c):
    return (f"'Forward-filled ' || n || ' missing values in time-series column ''{c}''. "
            "Assumes temporal state continuity until subsequent observation.'")


@register("missing_treatment_log", _CHAIN + f"""
SELECT "column", strategy, affected_records, imputed_value, reasoning, step FROM (
  SELECT 'o_custkey' AS "column", 'drop_rows' AS strategy, n AS affected_records, CAST(NULL AS VARCHAR) AS imputed_value,
         {_R_DROP} AS reasoning, 0 AS step FROM (SELECT count(*) FILTER (WHERE o_custkey IS NULL) AS n FROM missing)
  UNION ALL
  SELECT 'o_orderdate', 'forward_fill', n, 'propagated_prior_value', {_r_ffill('o_orderdate')}, 1
    FROM (SELECT count(*) FILTER (WHERE o_orderdate IS NULL) AS n FROM d)
  UNION ALL
  SELECT 'o_totalprice', 'forward_fill', n, 'propagated_prior_value', {_r_ffill('o_totalprice')}, 2
    FROM (SELECT count(*) FILTER (WHERE o_totalprice IS NULL) AS n FROM d)
  UNION ALL
  SELECT 'o_totalprice', 'median_imputation', n, CAST(round(med, 4) AS VARCHAR),
         'Imputed ' || n || ' missing values in ''o_totalprice'' using column median (' || CAST(round(med, 4) AS VARCHAR) || '). Median is chosen over mean because it is robust against outliers and distribution skewness.', 3
    FROM (SELECT count(*) FILTER (WHERE o_totalprice IS NULL) AS n, median(o_totalprice) AS med FROM f)
  UNION ALL
  SELECT 'o_orderpriority', 'mode_imputation', n, md,
         'Imputed ' || n || ' missing values in ''o_orderpriority'' using category mode (''' || md || '''). Preserves categorical distribution mode without introducing synthetic arbitrary categories.', 4
    FROM (SELECT count(*) FILTER (WHERE o_orderpriority IS NULL) AS n, {_MODE.format(c='o_orderpriority', src='m')} AS md FROM m)
  UNION ALL
  SELECT 'o_orderstatus', 'mode_imputation', n, md,
         'Imputed ' || n || ' missing values in ''o_orderstatus'' using category mode (''' || md || '''). Preserves categorical distribution mode without introducing synthetic arbitrary categories.', 5
    FROM (SELECT count(*) FILTER (WHERE o_orderstatus IS NULL) AS n, {_MODE.format(c='o_orderstatus', src='m')} AS md FROM m)
) WHERE affected_records > 0""")
def q_log(spark, sf):
    return handled(spark, sf)[1].withColumn("step", F.col("step").cast("int"))


def _cells(src):
    return " + ".join(f"count(*) FILTER (WHERE {c} IS NULL)" for c in COLS) + f" FROM {src}"


@register("missing_report", _CHAIN + f"""
SELECT b.rows_before, a.rows_after, b.rows_before - a.rows_after AS rows_removed,
       b.cells AS missing_cells_before, a.cells AS missing_cells_after,
       round(100 - round(b.cells / greatest(b.rows_before * 6, 1) * 100, 2), 2) AS completeness_before_pct,
       round(100 - round(a.cells / greatest(a.rows_after * 6, 1) * 100, 2), 2) AS completeness_after_pct
FROM (SELECT count(*) AS rows_before, {_cells('missing')}) AS b(rows_before, cells),
     (SELECT count(*) AS rows_after, {_cells('c')}) AS a(rows_after, cells)""")
def q_report(spark, sf):
    return missing.imputation_report(raw(spark, sf), handled(spark, sf)[0])


def workflow_input(spark, sf):
    m = raw(spark, sf)
    return m.unionByName(m.filter(F.col("o_orderkey") % 5 == 0))


@register("workflow_clean", M + """, w AS (SELECT DISTINCT * FROM (SELECT * FROM missing UNION ALL
                            SELECT * FROM missing WHERE o_orderkey % 5 = 0))
SELECT CAST(o_orderkey AS DOUBLE) AS o_orderkey,
       coalesce(CAST(o_custkey AS DOUBLE), (SELECT median(o_custkey) FROM w)) AS o_custkey, o_orderstatus,
       coalesce(o_totalprice, (SELECT median(o_totalprice) FROM w)) AS o_totalprice, o_orderdate, o_orderpriority
FROM w""")
def q_workflow(spark, sf):
    df = materialize(dedup.exact_dedup(workflow_input(spark, sf), order_col=None))  # medians and result share it
    return missing.median_fill_numeric(df)
