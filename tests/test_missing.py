import datetime as dt
import random

import pandas as pd
from pyspark.sql import functions as F

from fixtures import MISSING
from retentia.functions.order import forward_fill
from retentia.operators import missing


def _frame(spark):
    rows = [(i, a, b, c, d_, e, f, g, dt.date.fromisoformat(h) if h else None, j)
            for i, (a, b, c, d_, e, f, g, h, j) in enumerate(MISSING)]
    return spark.createDataFrame(rows, "row_id long, viewer_id string, user_name string, country string, "
                                       "subscription_plan string, monthly_fee double, watch_duration_minutes double, "
                                       "completion_rate double, viewing_date date, churn int")


PLAN = dict(critical_identifiers=["viewer_id"], numerical_median_cols=["monthly_fee", "watch_duration_minutes", "completion_rate"],
            categorical_mode_cols=["country", "subscription_plan", "user_name"], time_series_cols=["viewing_date"],
            date_sort_col="viewing_date")


def test_detect(spark):
    rows = {r["column"]: r for r in missing.detect_missing(_frame(spark)).collect()}
    assert rows["viewer_id"]["null_count"] == 2 and rows["viewer_id"]["null_percentage"] == 20.0
    assert rows["churn"]["has_missing"] is False
    t = missing.missing_totals(_frame(spark).drop("row_id")).first()
    assert t["total_missing_cells"] == 10 and t["total_cells"] == 90 and t["overall_missing_pct"] == 11.11


def test_golden_imputation(spark):
    cleaned, log = missing.handle_missing_values(_frame(spark), **PLAN)
    got = {r["viewer_id"]: r for r in cleaned.collect()}
    assert set(got) == {"V101", "V102", "V103", "V105", "V106", "V107", "V109", "V110"}
    assert got["V102"]["watch_duration_minutes"] == 50.0
    assert got["V103"]["user_name"] == "Alice Johnson" and got["V103"]["subscription_plan"] == "Premium"
    assert got["V105"]["monthly_fee"] == 11.99 and got["V105"]["viewing_date"] == dt.date(2025, 1, 10)
    assert got["V106"]["completion_rate"] == 0.8
    assert got["V107"]["country"] == "US"
    steps = [(r["column"], r["strategy"], r["affected_records"], r["imputed_value"])
             for r in log.orderBy("step").collect()]
    assert steps == [("viewer_id", "drop_rows", 2, None), ("viewing_date", "forward_fill", 1, "propagated_prior_value"),
                     ("monthly_fee", "median_imputation", 1, "11.99"), ("watch_duration_minutes", "median_imputation", 2, "50.0"),
                     ("completion_rate", "median_imputation", 1, "0.8"), ("country", "mode_imputation", 1, "US"),
                     ("subscription_plan", "mode_imputation", 1, "Premium"), ("user_name", "mode_imputation", 1, "Alice Johnson")]
    rep = missing.imputation_report(_frame(spark).drop("row_id"), cleaned.drop("row_id")).first()
    assert (rep["rows_before"], rep["rows_after"], rep["rows_removed"]) == (10, 8, 2)
    assert rep["missing_cells_after"] == 0 and rep["completeness_after_pct"] == 100.0


def test_mode_all_null_is_unknown(spark):
    df = spark.createDataFrame([(0, None), (1, None)], "row_id long, c string")
    out, _ = missing.handle_missing_values(df, categorical_mode_cols=["c"])
    assert [r["c"] for r in out.collect()] == ["Unknown", "Unknown"]


def test_forward_fill_matches_pandas(spark):
    rnd = random.Random(7)
    rows = []
    for i in range(400):
        day = None if rnd.random() < 0.2 else dt.date(2025, 1, 1) + dt.timedelta(days=rnd.randint(0, 90))
        val = None if rnd.random() < 0.4 else float(rnd.randint(0, 1000))
        rows.append((i, day, val))
    rows[0] = (0, rows[0][1], rows[0][2])
    df = spark.createDataFrame(rows, "row_id long, d date, v double")
    pdf = pd.DataFrame(rows, columns=["row_id", "d", "v"])
    pdf["_null"] = pdf["d"].isna()
    pdf = pdf.sort_values(["_null", "d", "row_id"], kind="stable")
    pdf["v"] = pdf["v"].ffill().bfill()
    want = dict(zip(pdf["row_id"], pdf["v"]))
    order = [F.col("d").isNull(), F.col("d"), F.col("row_id")]
    bucket = F.struct(F.col("d").isNull().alias("n"), F.col("d").alias("d"), F.floor(F.col("row_id") / 16).alias("b"))
    got = {r["row_id"]: r["v"] for r in forward_fill(df, "v", order, bucket).collect()}
    assert got == want


def test_median_fill_numeric(spark):
    df = spark.createDataFrame([(1, 1.0, "a"), (2, None, "b"), (None, 3.0, "c"), (4, 4.0, "d")], "a long, b double, s string")
    out = missing.median_fill_numeric(df).collect()
    assert [r["a"] for r in out] == [1.0, 2.0, 2.0, 4.0]
    assert [r["b"] for r in out] == [1.0, 3.0, 3.0, 4.0]
