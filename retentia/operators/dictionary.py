"""Data dictionary (G1, G3): the field catalogue as a small frame, evaluated against data.

The reference only stores its rules (allowed values, ranges, nullability,
primary key); here they are compiled into ONE aggregate of ``count_if``
expressions plus one ``groupBy(pk)`` for key uniqueness, then stacked into
``(column, rule, violations)`` rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DOMAINS = ["User & Subscription", "Viewing Consumption", "Engagement Dynamics", "Retention & Churn"]

# The reference's 22 dictionary fields, in its order:
# (name, domain, data_type, nullable, is_primary_key, allowed_values, min_value, max_value)
FIELDS = [
    ("viewer_id", "User & Subscription", "string", False, True, None, None, None),
    ("user_name", "User & Subscription", "string", False, False, None, None, None),
    ("country", "User & Subscription", "string", False, False, None, None, None),
    ("signup_date", "User & Subscription", "datetime", False, False, None, None, None),
    ("subscription_plan", "User & Subscription", "category", False, False, ["Basic", "Standard", "Premium"], None, None),
    ("monthly_fee", "User & Subscription", "float", False, False, None, 0.0, None),
    ("auto_renew", "User & Subscription", "boolean", False, False, None, None, None),
    ("content_id", "Viewing Consumption", "string", False, False, None, None, None),
    ("content_title", "Viewing Consumption", "string", False, False, None, None, None),
    ("genre", "Viewing Consumption", "category", False, False, None, None, None),
    ("watch_date", "Viewing Consumption", "datetime", False, False, None, None, None),
    ("watch_duration_minutes", "Viewing Consumption", "float", False, False, None, 0.0, None),
    ("total_content_duration_minutes", "Viewing Consumption", "float", False, False, None, 0.0, None),
    ("completion_rate", "Engagement Dynamics", "float", False, False, None, 0.0, 1.0),
    ("pause_frequency", "Engagement Dynamics", "integer", False, False, None, 0, None),
    ("episodes_watched", "Engagement Dynamics", "integer", False, False, None, 0, None),
    ("viewing_frequency_per_week", "Engagement Dynamics", "integer", False, False, None, 0, 7),
    ("binge_watching_flag", "Engagement Dynamics", "boolean", False, False, None, None, None),
    ("subscription_status", "Retention & Churn", "category", False, False, ["Active", "Paused", "Cancelled"], None, None),
    ("churn", "Retention & Churn", "binary", False, False, [0, 1], None, None),
    ("retention_risk_tier", "Retention & Churn", "category", False, False, ["Low", "Medium", "High", "Critical"], None, None),
    ("customer_lifetime_value", "Retention & Churn", "float", False, False, None, 0.0, None),
]


def dictionary_frame(spark: SparkSession) -> DataFrame:
    rows = [(n, d, t, nl, pk, [str(v) for v in av] if av is not None else None,
             float(mn) if mn is not None else None, float(mx) if mx is not None else None)
            for (n, d, t, nl, pk, av, mn, mx) in FIELDS]
    return spark.createDataFrame(rows, "field string, domain string, data_type string, nullable boolean, "
                                       "is_primary_key boolean, allowed_values array<string>, "
                                       "min_value double, max_value double")


def rule_violations(df: DataFrame) -> DataFrame:
    """Rows ``(column, rule, violations)`` for every dictionary rule that applies to a column of ``df``."""
    present = [f for f in FIELDS if f[0] in df.columns]
    checks = []   # (column, rule, count expression)
    pk_cols = []
    for (name, _d, _t, nullable, pk, allowed, mn, mx) in present:
        c = F.col(name)
        if not nullable:
            checks.append((name, "not_null", F.count_if(c.isNull())))
        if allowed is not None:
            checks.append((name, "allowed_values", F.count_if(c.isNotNull() & ~c.cast("string").isin([str(a) for a in allowed]))))
        if mn is not None:
            checks.append((name, "min_value", F.count_if(c.isNotNull() & (c.cast("double") < mn))))
        if mx is not None:
            checks.append((name, "max_value", F.count_if(c.isNotNull() & (c.cast("double") > mx))))
        if pk:
            pk_cols.append(name)
    if not checks and not pk_cols:
        return df.sparkSession.createDataFrame([], "column string, rule string, violations bigint")
    wide = df.agg(*[e.alias(f"v{i}") for i, (_, _, e) in enumerate(checks)]) if checks else None
    parts = []
    if wide is not None:
        parts.append(wide.select(F.explode(F.array(*[
            F.struct(F.lit(n).alias("column"), F.lit(r).alias("rule"), F.col(f"v{i}").cast("bigint").alias("violations"))
            for i, (n, r, _) in enumerate(checks)])).alias("x")).select("x.*"))
    for name in pk_cols:
        # Surplus rows per key value: a partial aggregate, safe with hot keys.
        dup = df.groupBy(name).agg(F.count(F.lit(1)).alias("_n")).agg(
            F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).cast("bigint").alias("violations"))
        parts.append(dup.select(F.lit(name).alias("column"), F.lit("primary_key_unique").alias("rule"), "violations"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def observed_columns(df: DataFrame) -> list[str]:
    """Columns holding at least one non-NULL value (one aggregate over the data).

    For semi-structured input (JSON records whose keys vary) this is the set of
    fields the data actually carries; a column that is NULL everywhere is absent.
    """
    row = df.agg(*[F.count(F.col(c)).alias(f"c{i}") for i, c in enumerate(df.columns)]).first()
    return [c for i, c in enumerate(df.columns) if row[f"c{i}"] > 0]


def schema_coverage(df: DataFrame, observed: bool = False) -> DataFrame:
    """Per domain: total_domain_fields, present_in_dataset, coverage_pct (1 dp), plus matched / unmatched lists.

    ``observed=True`` counts only columns that hold data (see ``observed_columns``).
    """
    spark = df.sparkSession
    if observed:
        df = df.select(*observed_columns(df))
    cols = spark.createDataFrame([(c,) for c in df.columns], "field string")
    dic = dictionary_frame(spark).select("field", "domain")
    j = dic.join(cols.withColumn("present", F.lit(True)), "field", "left")
    per = j.groupBy("domain").agg(F.count(F.lit(1)).alias("total_domain_fields"),
                                  F.count_if(F.col("present")).alias("present_in_dataset"))
    matched = ", ".join(sorted(set(df.columns) & {f[0] for f in FIELDS}))
    unmatched = ", ".join(sorted(set(df.columns) - {f[0] for f in FIELDS}))
    return per.select(
        "domain", "total_domain_fields", "present_in_dataset",
        F.round(F.col("present_in_dataset") / F.greatest(F.col("total_domain_fields"), F.lit(1)) * 100, 1)
        .alias("coverage_pct"),
        F.lit(len(df.columns)).cast("bigint").alias("total_dataset_columns"),
        F.lit(matched).alias("matched_columns"), F.lit(unmatched).alias("unmatched_dataset_columns"),
        F.lit(len({f[0] for f in FIELDS} - set(df.columns))).cast("bigint").alias("missing_standard_fields_count"))
