import pytest
from pyspark.sql import functions as F

from fixtures import transactions
from retentia.operators import kpi


def _kpis(spark):
    rows = kpi.compute_all_kpis(transactions(spark)).collect()
    return {r["kpi"]: (r["value"], r["formatted"]) for r in rows}


def test_golden_kpis(spark):
    k = _kpis(spark)
    assert k["monthly_active_users"] == (10.0, "10")
    assert k["revenue_per_customer"][0] == pytest.approx(280.533333, abs=1e-4)
    assert k["revenue_per_customer"][1] == "$280.53"
    assert k["churn_rate"] == (0.5, "50.0%")
    assert k["payment_success_rate"][0] == pytest.approx(0.866667, abs=1e-5)
    assert k["payment_success_rate"][1] == "86.7%"
    assert k["customer_acquisition_cost"][0] == pytest.approx(50.333333, abs=1e-5)
    assert k["customer_acquisition_cost"][1] == "$50.33"
    assert k["total_revenue"] == (4208.0, "$4,208.00")


def test_single_kpis_match_combined(spark):
    t = transactions(spark)
    assert kpi.mau(t).first()[0] == 10
    assert kpi.churn_rate(t).first()[0] == 0.5
    assert kpi.customer_acquisition_cost(t).first()[0] == pytest.approx(50.3333333)
    assert kpi.total_revenue(t).first()[0] == 4208.0
    assert kpi.reference_date_frame(t).first()[0].isoformat() == "2026-08-20"


def test_validation_statuses_and_summary(spark):
    v = kpi.validate_against_targets(kpi.compute_all_kpis(transactions(spark)), kpi.default_targets(spark))
    status = {r["kpi"]: r["status"] for r in v.collect()}
    assert [status[k] for k in kpi.KPI_NAMES] == ["PASS", "ALERT", "ALERT", "ALERT", "PASS", "ALERT"]
    s = kpi.validation_summary(v).first()
    assert s["summary"] == "ALERT: 4 KPI(s) outside target range"


def test_unknown_target_fails(spark):
    targets = spark.createDataFrame([("no_such_kpi", 0.0, 1.0)], "kpi string, min double, max double")
    with pytest.raises(Exception, match="unknown KPI"):
        kpi.validate_against_targets(kpi.compute_all_kpis(transactions(spark)), targets).collect()


def test_decomposition(spark):
    rows = kpi.decompose_total_revenue(transactions(spark)).collect()
    by = {(r["breakdown"], r["member"]): r["revenue"] for r in rows}
    assert by[("total", None)] == 4208.0
    assert by[("segment", "Enterprise")] == 1780 and by[("segment", "SMB")] == 1289 and by[("segment", "Startup")] == 1139
    assert by[("product", "Security")] == 1569 and by[("product", "Analytics")] == 1370 and by[("product", "Core")] == 1269
    assert all(r["sum_matches_total"] for r in rows)


def test_decomposition_null_segment_breaks_match(spark):
    t = transactions(spark).withColumn("customer_type", F.when(F.col("row_id") == 0, None).otherwise(F.col("customer_type")))
    rows = kpi.decompose_total_revenue(t).collect()
    flags = {r["breakdown"]: r["sum_matches_total"] for r in rows}
    assert flags["segment"] is False and flags["product"] is True


def test_churn_boundary_day_in_both_periods(spark):
    # A customer seen only on the boundary day is active in both periods -> not churned.
    rows = [(0, 1, "2026-01-31", 10, "A", "x", "success", 1), (1, 2, "2026-01-01", 10, "A", "x", "success", 1),
            (2, 3, "2026-03-02", 10, "A", "x", "success", 1)]
    import datetime as dt
    df = spark.createDataFrame([(a, b, dt.date.fromisoformat(c), d, e, f, g, h) for a, b, c, d, e, f, g, h in rows],
                               "row_id long, customer_id long, transaction_date date, amount bigint, customer_type string, "
                               "product string, payment_status string, acquisition_cost bigint")
    # anchor 2026-03-02: P2 = [01-31, 03-02], P1 = [01-01, 01-31]
    churned = {r[0] for r in kpi.churned_customers(df).collect()}
    assert churned == {2}
    assert kpi.churn_rate(df).first()[0] == pytest.approx(0.5)


def test_empty_input_defaults(spark):
    df = transactions(spark).limit(0)
    k = kpi.kpi_values(df).first()
    assert k["revenue_per_customer"] == 0.0 and k["churn_rate"] == 0.0 and k["payment_success_rate"] == 0.0
