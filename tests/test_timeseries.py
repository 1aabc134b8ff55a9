import datetime as dt
import random

import pandas as pd
import pytest

from fixtures import daily
from retentia.functions.order import rolling_mean_rows, row_index
from retentia.operators import timeseries as tsr
from pyspark.sql import functions as F


def test_weekly_monthly_golden(spark):
    w = tsr.weekly(daily(spark)).orderBy("period").collect()
    assert len(w) == 14
    assert (w[0]["period"], w[0]["revenue_sum"], w[0]["orders_count"], w[0]["revenue_mean"]) == (dt.date(2025, 1, 5), 515, 5, 103.0)
    assert (w[-1]["period"], w[-1]["revenue_sum"], w[-1]["orders_count"]) == (dt.date(2025, 4, 6), 118, 1)
    m = tsr.mom_change(daily(spark)).orderBy("period").collect()
    assert [r["revenue_sum"] for r in m] == [3689, 4775, 4735]
    assert m[0]["mom_change_pct"] is None
    assert round(m[1]["mom_change_pct"], 2) == 29.44 and round(m[2]["mom_change_pct"], 2) == -0.84
    g = {r["kind"]: r["month"] for r in tsr.growth_decline(daily(spark)).collect()}
    assert g == {"growth": dt.date(2025, 2, 28), "decline": dt.date(2025, 3, 31)}


def test_trend_golden(spark):
    t = tsr.trend(daily(spark)).first()
    assert t["trend_direction"] == "down" and t["total_revenue"] == 13199.0
    assert t["trend_magnitude_pct"] == pytest.approx(-11.747572815533976, abs=1e-9)
    assert t["business_interpretation"] == "Declining momentum - investigate causes"
    h = tsr.highest_month(daily(spark)).first()
    assert h["highest_revenue_month"] == dt.date(2025, 2, 28)


def test_empty_weeks_present(spark):
    df = spark.createDataFrame([(dt.date(2025, 1, 1), 5, 1), (dt.date(2025, 1, 20), 7, 1)], "date date, revenue bigint, orders bigint")
    w = tsr.weekly(df).orderBy("period").collect()
    assert [(r["revenue_sum"], r["orders_count"], r["revenue_mean"]) for r in w] == [(5, 1, 5.0), (0, 0, None), (0, 0, None), (7, 1, 7.0)]


def test_zero_base_percent_change(spark):
    df = spark.createDataFrame([(dt.date(2025, 1, 1), 0, 1), (dt.date(2025, 2, 1), 5, 1), (dt.date(2025, 3, 1), 0, 1),
                                (dt.date(2025, 4, 1), 0, 1)], "date date, revenue bigint, orders bigint")
    m = [r["mom_change_pct"] for r in tsr.mom_change(df).orderBy("period").collect()]
    assert m[0] is None and m[1] == float("inf") and m[2] == -100.0 and m[3] is None


def test_block_rolling_and_index_match_pandas(spark):
    rnd = random.Random(1)
    rows = [(i, float(rnd.randint(0, 100))) for i in range(300)]
    df = spark.createDataFrame(rows, "t long, v double")
    idx = row_index(df, "idx", [F.col("t")], F.floor(F.col("t") / 17))
    out = rolling_mean_rows(idx, "v", "idx", 7, "ma", block=32).orderBy("t").collect()
    want = pd.Series([v for _, v in rows]).rolling(7).mean()
    assert [r["idx"] for r in out] == list(range(300))
    got = [r["ma"] for r in out]
    assert all((g is None and pd.isna(w)) or g == pytest.approx(w) for g, w in zip(got, want))


def test_cumulative(spark):
    c = tsr.cumulative(daily(spark)).orderBy("date").collect()
    assert c[-1]["cumulative_revenue"] == 13199 and c[0]["cumulative_revenue"] == 100


def test_repeated_dates_have_one_order(spark):
    """Two and more rows of a date give the same averages and sums whatever the order of the input."""
    rnd = random.Random(2)
    rows = [(dt.date(2025, 1, 1) + dt.timedelta(days=i // 3), rnd.randint(0, 9) * 1.0, rnd.randint(1, 3)) for i in range(200)]
    seen = set()
    for k in range(3):
        random.Random(k).shuffle(rows)
        df = spark.createDataFrame(rows, "date date, revenue double, orders int").repartition(3 + k)
        seen.add(tuple(sorted(map(tuple, tsr.chart_series(df).select("idx", "date", "revenue", "orders", "revenue_ma7", "revenue_ma30",
                                                                   "cumulative_revenue").collect()), key=str)))
    assert len(seen) == 1
    ordered = sorted(rows)
    want = pd.Series([r[1] for r in ordered]).rolling(7).mean()
    got = sorted(map(tuple, tsr.chart_series(df).select("idx", "revenue_ma7", "cumulative_revenue").collect()), key=lambda r: r[0])
    assert [g[2] for g in got] == list(pd.Series([r[1] for r in ordered]).cumsum())
    assert all(g[1] is None and pd.isna(w) or g[1] == pytest.approx(w) for g, w in zip(got, want))
