"""KPI family: MAU, revenue per customer, churn, payment success, CAC, total revenue,
target validation and revenue decomposition.

Plan shape: the reference rescans its frame once per KPI.  Here every
per-customer quantity comes from ONE ``groupBy(customer_id)`` (partial
aggregation map-side, so a customer with a third of all rows collapses
before the shuffle), followed by one global aggregate.  The reference date is
a scalar subquery, which Spark runs once and also pushes into the scan as a
runtime filter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.numfmt import fmt_money, fmt_percent, fmt_thousands

DATE = "transaction_date"
CUSTOMER = "customer_id"

# KPI names, in the reference's report order.
KPI_NAMES = ["monthly_active_users", "revenue_per_customer", "churn_rate",
             "payment_success_rate", "customer_acquisition_cost", "total_revenue"]


def reference_date(df: DataFrame, explicit=None) -> Column:
    """Explicit anchor, else ``max(transaction_date)`` as a scalar subquery."""
    if explicit is not None:
        return F.lit(explicit).cast("date")
    return df.select(F.max(DATE)).scalar()


def reference_date_frame(df: DataFrame) -> DataFrame:
    return df.agg(F.max(DATE).alias("reference_date"))


def _cutoff(anchor: Column, days: int) -> Column:
    return F.date_sub(anchor, days)


def mau(df: DataFrame, days: int = 30, anchor=None) -> DataFrame:
    a = reference_date(df, anchor)
    return (df.filter(F.col(DATE) >= _cutoff(a, days))
            .agg(F.count_distinct(CUSTOMER).alias("monthly_active_users")))


def revenue_per_customer(df: DataFrame) -> DataFrame:
    per = df.groupBy(CUSTOMER).agg(F.sum("amount").alias("_amt"))
    return per.agg(F.coalesce(F.try_divide(F.sum("_amt"), F.count(CUSTOMER)), F.lit(0.0))
                   .cast("double").alias("revenue_per_customer"))


def _period_flags(anchor: Column, period_days: int):
    p2_start = _cutoff(anchor, period_days)
    p1_start = _cutoff(anchor, 2 * period_days)
    d = F.col(DATE)
    # Both periods are closed, so the boundary day belongs to both.
    in_p1 = (d >= p1_start) & (d <= p2_start)
    in_p2 = (d >= p2_start) & (d <= anchor)
    return in_p1, in_p2, p1_start


def churned_customers(df: DataFrame, period_days: int = 30, anchor=None) -> DataFrame:
    """Customers active in period 1 and not in period 2 (the reference's set difference)."""
    a = reference_date(df, anchor)
    in_p1, in_p2, p1_start = _period_flags(a, period_days)
    p1 = df.filter(in_p1).select(CUSTOMER).distinct()
    p2 = df.filter(in_p2).select(CUSTOMER).distinct()
    return p1.join(p2, CUSTOMER, "left_anti")


def churn_rate(df: DataFrame, period_days: int = 30, anchor=None) -> DataFrame:
    a = reference_date(df, anchor)
    in_p1, in_p2, p1_start = _period_flags(a, period_days)
    per = (df.filter((F.col(DATE) >= p1_start) & (F.col(DATE) <= a))
           .groupBy(CUSTOMER).agg(F.bool_or(in_p1).alias("p1"), F.bool_or(in_p2).alias("p2")))
    return per.agg(F.coalesce(F.try_divide(F.count_if(F.col("p1") & ~F.col("p2")).cast("double"),
                                           F.count_if("p1").cast("double")), F.lit(0.0)).alias("churn_rate"))


def payment_success_rate(df: DataFrame) -> DataFrame:
    # count(*) counts rows whose status is NULL too; the status is lower-cased, not trimmed.
    return df.agg(F.coalesce(F.try_divide(
        F.count_if(F.lower("payment_status") == "success").cast("double"),
        F.count(F.lit(1)).cast("double")), F.lit(0.0)).alias("payment_success_rate"))


def customer_acquisition_cost(df: DataFrame, order_col: str = "row_id") -> DataFrame:
    """Mean over customers of each customer's first non-null cost in row order."""
    per = (df.filter(F.col("acquisition_cost").isNotNull())
           .groupBy(CUSTOMER).agg(F.min_by("acquisition_cost", order_col).alias("_cost")))
    return per.agg(F.coalesce(F.avg("_cost"), F.lit(0.0)).cast("double").alias("customer_acquisition_cost"))


def total_revenue(df: DataFrame) -> DataFrame:
    return df.agg(F.coalesce(F.sum("amount"), F.lit(0)).cast("double").alias("total_revenue"))


def kpi_values(df: DataFrame, anchor=None, mau_days: int = 30, period_days: int = 30,
               order_col: str = "row_id") -> DataFrame:
    """All six KPIs in one row from one per-customer pre-aggregate."""
    a = reference_date(df, anchor)
    in_p1, in_p2, _ = _period_flags(a, period_days)
    d = F.col(DATE)
    per = df.groupBy(CUSTOMER).agg(
        F.bool_or(d >= _cutoff(a, mau_days)).alias("active"),
        F.bool_or(in_p1).alias("p1"),
        F.bool_or(in_p2).alias("p2"),
        F.min_by("acquisition_cost", F.when(F.col("acquisition_cost").isNotNull(), F.col(order_col))).alias("cost"),
        F.sum("amount").alias("amt"),
        F.count(F.lit(1)).alias("rows"),
        F.count_if(F.lower("payment_status") == "success").alias("ok"),
    )
    n_cust = F.count(CUSTOMER)
    return per.agg(
        F.count_if("active").cast("double").alias("monthly_active_users"),
        F.coalesce(F.try_divide(F.sum("amt"), n_cust), F.lit(0.0)).cast("double").alias("revenue_per_customer"),
        F.coalesce(F.try_divide(F.count_if(F.col("p1") & ~F.col("p2")).cast("double"),
                                F.count_if("p1").cast("double")), F.lit(0.0)).alias("churn_rate"),
        F.coalesce(F.try_divide(F.sum("ok").cast("double"), F.sum("rows").cast("double")),
                   F.lit(0.0)).alias("payment_success_rate"),
        F.coalesce(F.avg("cost"), F.lit(0.0)).cast("double").alias("customer_acquisition_cost"),
        F.coalesce(F.sum("amt"), F.lit(0)).cast("double").alias("total_revenue"),
    )


def _formatted(kpi: Column, value: Column) -> Column:
    return (F.when(kpi == "monthly_active_users", fmt_thousands(value))
            .when(kpi.isin("churn_rate", "payment_success_rate"), fmt_percent(value, 1))
            .otherwise(fmt_money(value, 2)))


def compute_all_kpis(df: DataFrame, anchor=None, **kw) -> DataFrame:
    """Long form ``(kpi, value, formatted)``, one row per KPI."""
    wide = kpi_values(df, anchor, **kw)
    longf = wide.unpivot([], KPI_NAMES, "kpi", "value")
    return longf.select("kpi", "value", _formatted(F.col("kpi"), F.col("value")).alias("formatted"))


def validate_against_targets(kpis: DataFrame, targets: DataFrame) -> DataFrame:
    """Inclusive range check per target row.  A target naming an unknown KPI fails
    the job (the reference raises ``KeyError``)."""
    j = targets.join(kpis, "kpi", "left")
    actual = F.when(F.col("value").isNull(),
                    F.raise_error(F.concat(F.lit("unknown KPI in targets: "), F.col("kpi"))).cast("double")
                    ).otherwise(F.col("value"))
    lo, hi = F.col("min").cast("double"), F.col("max").cast("double")
    return j.select(
        "kpi", actual.alias("actual"), "formatted", lo.alias("target_min"), hi.alias("target_max"),
        F.when((lo <= actual) & (actual <= hi), "PASS").otherwise("ALERT").alias("status"))


def validation_summary(validation: DataFrame) -> DataFrame:
    agg = validation.agg(F.count_if(F.col("status") == "ALERT").alias("alerts"),
                         F.count(F.lit(1)).alias("kpis"))
    line = F.when(F.col("alerts") > 0,
                  F.format_string("ALERT: %d KPI(s) outside target range", F.col("alerts")))\
        .otherwise(F.format_string("PASS: all %d KPI(s) within target range", F.col("kpis")))
    return agg.select("alerts", "kpis", line.alias("summary"))


def decompose_total_revenue(df: DataFrame, tolerance: float = 1e-9) -> DataFrame:
    """Total revenue, revenue by segment and by product in ONE grouping-sets pass.

    Rows: ``(breakdown, member, revenue, rank, sum_matches_total)``; ``rank`` is the
    descending order of a breakdown's members (ties by name).  pandas drops
    NULL group keys, so a NULL segment or product is dropped from its own
    breakdown but still counts in the total; the match flag then turns false,
    which is the check's purpose.  Floating sums are compared with a relative
    tolerance because partial sums are added in a different order per task.
    """
    gs = (df.groupingSets([["customer_type"], ["product"], []], "customer_type", "product")
          .agg(F.sum("amount").alias("revenue"), F.grouping_id().alias("_gid")))
    # grouping_id bits: customer_type is the high bit.  gid 1 -> by segment, 2 -> by product, 3 -> total.
    breakdown = F.when(F.col("_gid") == 1, "segment").when(F.col("_gid") == 2, "product").otherwise("total")
    member = F.when(F.col("_gid") == 1, F.col("customer_type")).when(F.col("_gid") == 2, F.col("product"))
    # Integer amounts keep integer sums (the reference's by-segment values are ints).
    rows = gs.select(breakdown.alias("breakdown"), member.alias("member"), F.col("revenue"))
    rows = rows.filter((F.col("breakdown") == "total") | F.col("member").isNotNull())
    part_sums = rows.groupBy("breakdown").agg(F.sum("revenue").alias("_parts"))
    total = rows.filter(F.col("breakdown") == "total").select(F.col("revenue")).scalar()
    checks = part_sums.select(
        "breakdown",
        (F.abs(F.col("_parts") - total) <= F.lit(tolerance) * F.greatest(F.lit(1.0), F.abs(total).cast("double")))
        .alias("sum_matches_total"))
    order = W.partitionBy("breakdown").orderBy(F.desc("revenue"), "member")  # a few members
    return rows.withColumn("rank", F.row_number().over(order)).join(checks, "breakdown", "left")


# The reference's KPI target ranges (min, max), in file order.
DEFAULT_TARGETS = [
    ("monthly_active_users", 9.0, 12.0),
    ("revenue_per_customer", 120.0, 170.0),
    ("churn_rate", 0.0, 0.35),
    ("payment_success_rate", 0.9, 1.0),
    ("customer_acquisition_cost", 30.0, 55.0),
    ("total_revenue", 1500.0, 2500.0),
]


def default_targets(spark) -> DataFrame:
    return spark.createDataFrame(DEFAULT_TARGETS, "kpi string, min double, max double")
