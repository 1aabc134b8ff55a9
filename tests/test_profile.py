import pytest
from pyspark.sql import functions as F

from retentia.operators import dictionary, profile


def _frame(spark):
    rows = [(1, "A", 100.0, 0), (2, "B", 200.0, 1), (3, None, 150.0, 0), (4, "A", 5000.0, 1), (5, "C", 120.0, 0),
            (5, "C", 120.0, 0)]
    return spark.createDataFrame(rows, "id int, category string, revenue double, churn int")


def test_shape_completeness_uniqueness(spark):
    df = _frame(spark)
    s = profile.profile_shape(df).first()
    assert (s["total_rows"], s["total_columns"]) == (6, 4)
    comp = {r["column"]: r for r in profile.profile_completeness(df).collect()}
    assert comp["category"]["null_count"] == 1 and comp["category"]["null_percentage"] == 16.67
    assert comp["id"]["overall_completeness_pct"] == 95.83
    u = profile.profile_uniqueness(df, "id").first()
    assert u["exact_duplicate_rows"] == 1 and u["primary_key_duplicates"] == 1 and u["primary_key_unique"] is False


def test_numeric_profile_matches_pandas(spark):
    df = _frame(spark)
    pdf = df.toPandas()
    rows = {r["column"]: r for r in profile.profile_numeric(df).collect()}
    s = pdf["revenue"]
    r = rows["revenue"]
    assert r["count"] == 6 and r["mean"] == round(s.mean(), 4) and r["std"] == round(s.std(), 4)
    assert (r["q25"], r["median"], r["q75"]) == (round(s.quantile(.25), 4), round(s.median(), 4), round(s.quantile(.75), 4))
    assert r["skewness"] == round(s.skew(), 4)
    iqr = s.quantile(.75) - s.quantile(.25)
    out = ((s < s.quantile(.25) - 1.5 * iqr) | (s > s.quantile(.75) + 1.5 * iqr)).sum()
    assert r["outlier_count"] == out == 1
    assert "category" not in rows


def test_categorical_top_values(spark):
    rows = profile.profile_categorical(_frame(spark), max_top=2).orderBy("top_rank").collect()
    assert rows[0]["total_non_null"] == 5 and rows[0]["unique_values"] == 3 and rows[0]["cardinality_pct"] == 50.0
    assert [(r["top_value"], r["top_count"]) for r in rows] == [("A", 2), ("C", 2)]


def test_quality_score(spark):
    df = _frame(spark).withColumn("tickets_count", F.lit(-1))
    q = profile.assess_quality(df).first()
    assert q["quality_status"] == "NEEDS_ATTENTION"
    assert "Negative values found in non-negative domain column 'tickets_count'" in q["critical_issues"]
    assert q["warnings"].startswith("Found 1 exact duplicate rows")
    clean = spark.createDataFrame([(1, 2.0), (2, 3.0)], "a int, b double")
    q2 = profile.assess_quality(clean).first()
    assert q2["overall_quality_score"] == 80.0 and q2["quality_status"] == "GOOD"


def test_high_missing_issue(spark):
    df = spark.createDataFrame([(1, None), (2, None), (3, "x")], "a int, b string")
    q = profile.assess_quality(df).first()
    assert q["critical_issues"] == "High missingness (>20%) detected in: ['b']"


def test_dictionary_coverage_and_rules(spark):
    df = spark.createDataFrame([("V1", "Bob", "US", "Gold", 3.0), ("V1", None, "US", "Basic", -1.0)],
                               "viewer_id string, user_name string, country string, subscription_plan string, unknown_col double")
    cov = {r["domain"]: r for r in dictionary.schema_coverage(df).collect()}
    assert cov["User & Subscription"]["present_in_dataset"] == 4 and cov["User & Subscription"]["coverage_pct"] == 57.1
    assert cov["Retention & Churn"]["coverage_pct"] == 0.0
    assert cov["Viewing Consumption"]["unmatched_dataset_columns"] == "unknown_col"
    v = {(r["column"], r["rule"]): r["violations"] for r in dictionary.rule_violations(df).collect()}
    assert v[("viewer_id", "primary_key_unique")] == 1
    assert v[("user_name", "not_null")] == 1
    assert v[("subscription_plan", "allowed_values")] == 1
    assert len(dictionary.FIELDS) == 22


def test_report_is_one_row(spark):
    r = profile.dataset_profile(_frame(spark), "demo", "id")
    assert r.count() == 1
    row = r.first()
    assert row["shape"]["total_rows"] == 6 and len(row["completeness"]) == 4


def test_observed_coverage(spark):
    from pyspark.sql import functions as F
    df = spark.createDataFrame([("V1", None), ("V2", None)], "viewer_id string, country string")
    cov = {r["domain"]: r for r in dictionary.schema_coverage(df, observed=True).collect()}
    assert cov["User & Subscription"]["present_in_dataset"] == 1
    cov2 = {r["domain"]: r for r in dictionary.schema_coverage(df).collect()}
    assert cov2["User & Subscription"]["present_in_dataset"] == 2
