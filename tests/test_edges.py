"""Empty inputs, single rows and all-NULL columns across the operator families."""

import datetime as dt

from pyspark.sql import functions as F

from retentia.functions.stats import exact_quantiles
from retentia.operators import correlation as co
from retentia.operators import dedup, distribution as ds, missing, profile, segments as sg


def test_empty_frames(spark):
    e = spark.createDataFrame([], "row_id long, k string, v double")
    assert exact_quantiles(e, "v", [0.5], names=["m"]).first()["m"] is None
    assert exact_quantiles(e, "v", [0.5], group="k").count() == 0
    kept, removed = dedup.deduplicate(e, "first", ["k"])
    assert kept.count() == 0 and removed.count() == 0
    assert dedup.exact_duplicate_stats(e).first()["exact_duplicate_rows"] == 0
    assert profile.profile_numeric(e.select("v")).count() == 0
    assert missing.detect_missing(e).count() == 3
    rev = spark.createDataFrame([], "revenue double")
    assert ds.histogram(rev).count() == 0
    assert ds.density(rev).count() == 0


def test_single_row_and_all_null(spark):
    one = spark.createDataFrame([(1.0,)], "revenue double")
    assert exact_quantiles(one, "revenue", [0.25, 0.99], names=["a", "b"]).first() == (1.0, 1.0)
    h = ds.histogram(one).orderBy("bin").collect()
    assert sum(r["count"] for r in h) == 1 and h[0]["bin_start"] == 0.5
    df = spark.createDataFrame([(1, None), (2, None), (3, None)], "id int, x double")
    p = {r["column"]: r for r in profile.profile_numeric(df).collect()}
    assert "x" not in p and p["id"]["std"] == 1.0 and p["id"]["skewness"] == 0.0


def test_constant_column_profile_and_corr(spark):
    df = spark.createDataFrame([(i, 5.0) for i in range(5)], "customer_id long, c double")
    p = {r["column"]: r for r in profile.profile_numeric(df).collect()}
    assert p["c"]["std"] == 0.0 and p["c"]["skewness"] == 0.0 and p["c"]["outlier_count"] == 0
    s = {(r["feature_a"], r["feature_b"]): r["r"] for r in co.spearman_matrix(df, ["customer_id", "c"]).collect()}
    assert s[("customer_id", "c")] is None


def test_segment_ties_rank_dense(spark):
    rows = [(1, "A", "p", 10, 1, 1), (2, "B", "p", 10, 1, 1), (3, "C", "p", 10, 1, 0)]
    df = spark.createDataFrame(rows, "customer_id long, customer_type string, product string, revenue bigint, "
                                     "support_tickets bigint, churn bigint")
    r = {x["customer_type"]: x["churn_rank"] for x in sg.segment_ranked(df).collect()}
    assert r == {"A": 1.0, "B": 1.0, "C": 2.0}
