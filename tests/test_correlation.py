import pytest

from fixtures import CORRELATION
from retentia.operators import correlation as co


def _frame(spark):
    return spark.createDataFrame(CORRELATION, "customer_id long, engagement bigint, transactions_per_month bigint, "
                                              "support_tickets bigint, churn bigint")


def test_pearson_and_spearman_golden(spark):
    p = {(r["feature_a"], r["feature_b"]): r["r"] for r in co.pearson_matrix(_frame(spark)).collect()}
    assert p[("support_tickets", "churn")] == pytest.approx(0.8790490729915326, abs=1e-9)
    s = {(r["feature_a"], r["feature_b"]): r["r"] for r in co.spearman_matrix(_frame(spark)).collect()}
    assert round(s[("support_tickets", "churn")], 4) == 0.8706
    assert round(s[("engagement", "churn")], 4) == 0.869


def test_strong_pairs_golden(spark):
    rows = co.strong_pairs(_frame(spark)).collect()
    pairs = [(r["feature_a"], r["feature_b"]) for r in rows]
    assert pairs == [("engagement", "transactions_per_month"), ("engagement", "support_tickets"),
                     ("support_tickets", "transactions_per_month"), ("churn", "support_tickets"),
                     ("churn", "transactions_per_month"), ("churn", "engagement")]


def test_constant_column_is_null_not_error(spark):
    df = spark.createDataFrame([(1, 1.0, 5.0), (2, 2.0, 5.0), (3, 3.0, 5.0)], "customer_id long, a double, b double")
    m = {(r["feature_a"], r["feature_b"]): r["r"] for r in co.pearson_matrix(df, ["a", "b"]).collect()}
    assert m[("a", "b")] is None


def test_compare_select_interpret(spark):
    c = {r["feature"]: r for r in co.compare_with_target(_frame(spark)).collect()}
    assert round(c["transactions_per_month"]["pearson"], 4) == 0.869
    assert co.select_features(_frame(spark)).columns == ["customer_id", "transactions_per_month", "support_tickets", "churn"]
    i = co.interpretation(_frame(spark)).first()
    assert i["correlation"] == pytest.approx(0.87904907, abs=1e-8)


def test_least_squares(spark):
    df = spark.createDataFrame([(1.0, 3.0), (2.0, 5.0), (3.0, 7.0)], "x double, y double")
    rows = co.least_squares(df, "x", "y", 3).orderBy("point").collect()
    assert rows[0]["slope"] == pytest.approx(2.0) and rows[0]["intercept"] == pytest.approx(1.0)
    assert [r["y_hat"] for r in rows] == pytest.approx([3.0, 5.0, 7.0])


def test_spearman_ranks_with_ties(spark):
    s = {(r["feature_a"], r["feature_b"]): r["r"] for r in co.spearman_matrix(_frame(spark)).collect()}
    assert round(s[("support_tickets", "churn")], 4) == 0.8706
    assert round(s[("engagement", "churn")], 4) == 0.869
