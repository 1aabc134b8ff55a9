import pytest

from fixtures import PROFILES, SEGMENTS
from retentia.operators import segments as sg


def _seg(spark):
    return spark.createDataFrame(SEGMENTS, "customer_id long, customer_type string, product string, revenue bigint, "
                                           "support_tickets bigint, churn bigint")


def _prof(spark):
    return spark.createDataFrame(PROFILES, "customer_id long, customer_type string, lifetime_value bigint, churn bigint, "
                                           "support_tickets bigint, retention_days bigint")


def test_segment_golden(spark):
    r = {x["customer_type"]: x for x in sg.segment_ranked(_seg(spark)).collect()}
    assert (r["Enterprise"]["churn_rate"], r["Medium"]["churn_rate"], r["Small"]["churn_rate"]) == (0.25, 0.5, 0.5)
    assert (r["Enterprise"]["churn_rank"], r["Medium"]["churn_rank"], r["Small"]["churn_rank"]) == (2.0, 1.0, 1.0)
    assert r["Enterprise"]["revenue_contribution"] == pytest.approx(65.2819, abs=1e-4)
    assert r["Medium"]["revenue_contribution"] == pytest.approx(27.2008, abs=1e-4)
    assert r["Small"]["revenue_contribution"] == pytest.approx(7.5173, abs=1e-4)
    assert r["Enterprise"]["customer_count"] == 4 and r["Enterprise"]["total_revenue"] == 6600


def test_pivots_and_insights(spark):
    p = {x["customer_type"]: x for x in sg.revenue_pivot(_seg(spark)).collect()}
    assert (p["Enterprise"]["Analytics"], p["Enterprise"]["Security"]) == (2700, 3900)
    u = {x["customer_type"]: x for x in sg.segment_product_unstacked(_seg(spark)).collect()}
    assert u["Small"]["customer_count_Security"] == 2
    ins = {x["segment"]: x for x in sg.segment_insights(_seg(spark)).collect()}
    assert ins["Enterprise"]["total_revenue"] == "$6600" and ins["Enterprise"]["churn_rate"] == "25.0%"
    assert ins["Enterprise"]["revenue_contribution"] == "65.3%"
    assert ins["Small"]["action"].startswith("HIGH PRIORITY")


def test_strategy_golden(spark):
    s = {x["customer_type"]: x for x in sg.strategy_summary(_prof(spark)).collect()}
    assert s["Enterprise"]["avg_ltv_display"] == "$159,000" and s["SMB"]["avg_ltv_display"] == "$9,917"
    assert s["Startup"]["avg_ltv"] == 2225.0
    assert [s[k]["avg_retention_display"] for k in ("Enterprise", "SMB", "Startup")] == ["463 days", "182 days", "112 days"]
    assert [s[k]["churn_rank"] for k in ("Enterprise", "SMB", "Startup")] == [1.0, 3.0, 2.0]
    assert [s[k]["segment_share_display"] for k in ("Enterprise", "SMB", "Startup")] == ["26.3%", "31.6%", "42.1%"]
    assert s["SMB"]["churn_rate_display"] == "50.0%" and s["Startup"]["avg_tickets_display"] == "6.00"


def test_performers_and_narrative(spark):
    p = {x["insight"]: x for x in sg.strategy_performers(_prof(spark)).collect()}
    assert p["highest_value_segment"]["segment"] == "Enterprise"
    assert p["highest_churn_segment"]["segment"] == "SMB"
    assert p["best_retention_segment"]["segment"] == "Enterprise"
    lines = [x["line"] for x in sg.strategy_narrative(_prof(spark)).orderBy("line_no").collect()]
    assert lines[0] == "SEGMENT STRATEGY SUMMARY:"
    assert lines[1] == "Enterprise (26.3% of base, $159,000 avg LTV, 0.0% churn):"
    assert lines[2] == "- Action: Maintain premium support and proactive retention programs"
    assert lines[3].startswith("SMB (31.6% of base, $9,917 avg LTV, 50.0% churn)")
    assert len(lines) == 7


def test_null_segment_dropped(spark):
    df = _seg(spark).union(spark.createDataFrame([(99, None, "Core", 1, 1, 1)], _seg(spark).schema))
    assert {x["customer_type"] for x in sg.segment_metrics(df).collect()} == {"Enterprise", "Medium", "Small"}


def test_unlisted_product_keeps_its_share(spark):
    import datetime as dt

    from retentia.operators import charts
    day = dt.date(2024, 2, 3)
    df = spark.createDataFrame([(day, "AF", 10.0, 1.0), (day, "ZZ", 90.0, 2.0), (dt.date(2023, 11, 1), "AF", 5.0, 1.0)],
                               "order_date date, product_line string, order_amount double, marketing_spend double")
    got = {(r["quarter"], r["product_line"]): (r["revenue"], r["share"]) for r in charts.quarterly_composition(df).collect()}
    assert got == {("2024Q1", "AF"): (10.0, 0.1), ("2024Q1", "ZZ"): (90.0, 0.9),
                   ("2023Q4", "AF"): (5.0, 1.0), ("2023Q4", "ZZ"): (0.0, 0.0)}
