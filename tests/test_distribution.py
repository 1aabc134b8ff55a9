import numpy as np
import pytest
from pyspark.sql import functions as F

from fixtures import SAMPLE
from retentia.functions.stats import exact_quantiles
from retentia.operators import distribution as ds


def _rev(spark, values):
    return spark.createDataFrame([(float(v),) for v in values], "revenue double")


def test_golden_shape_and_percentiles(spark):
    rev = _rev(spark, [r[2] for r in SAMPLE])
    s = ds.shape(rev).first()
    assert s["skewness"] == pytest.approx(-0.24633987, abs=1e-6)
    assert s["kurtosis"] == pytest.approx(-1.5, abs=1e-9)
    p = {r["percentile"]: r["value"] for r in ds.percentiles(rev).collect()}
    assert p["0.25"] == pytest.approx(112.875) and p["0.9"] == pytest.approx(190.1) and p["0.99"] == pytest.approx(199.01)
    d = ds.describe(rev).first()
    assert d["std"] == pytest.approx(62.81636596726472) and d["50%"] == 150.5
    seg = {r["segment"]: r for r in ds.value_segments(rev).collect()}
    assert (seg["high"]["count"], seg["high"]["median"]) == (1, 200.0)
    assert (seg["low"]["count"], seg["low"]["mean"]) == (1, 75.25)
    i = ds.interpretation(rev).first()
    assert (i["shape"], i["tails"]) == ("Moderate", "Normal")


def test_exact_quantiles_against_numpy(spark):
    rng = np.random.default_rng(3)
    vals = np.concatenate([rng.integers(0, 50, 500), np.full(700, 7)]).astype(float)  # one hot value
    df = _rev(spark, vals)
    qs = [0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 0.99, 1.0]
    row = exact_quantiles(df, "revenue", qs, names=[f"q{i}" for i in range(len(qs))]).first()
    assert [row[f"q{i}"] for i in range(len(qs))] == pytest.approx(list(np.quantile(vals, qs)))


def test_histogram_matches_numpy(spark):
    vals = [1.0, 2.0, 2.5, 3.0, 10.0, 10.0, 4.0]
    rows = ds.histogram(_rev(spark, vals)).orderBy("bin").collect()
    counts, edges = np.histogram(vals, bins=min(50, max(5, len(set(vals)))))
    assert [r["count"] for r in rows] == list(counts)
    assert [r["bin_start"] for r in rows] == pytest.approx(list(edges[:-1]))


def test_density_matches_direct_sum(spark):
    vals = np.array([75.25, 150.5, 200.0, 120.0, 130.0])
    d = ds.density(_rev(spark, vals), points=50).orderBy("point").collect()
    bw = vals.std(ddof=1) * len(vals) ** -0.2
    rng_ = vals.max() - vals.min()
    xs = np.linspace(vals.min() - rng_ / 2, vals.max() + rng_ / 2, 50)
    want = [np.exp(-0.5 * ((x - vals) / bw) ** 2).sum() / (len(vals) * bw * np.sqrt(2 * np.pi)) for x in xs]
    assert [r["density"] for r in d] == pytest.approx(want, rel=1e-9)


def test_load_revenue_guard(spark):
    from retentia.sources.loaders import load_revenue
    df = spark.createDataFrame([(1, "5"), (2, "-3")], "customer_id int, transaction_amount string")
    with pytest.raises(Exception, match="revenue distribution needs 2 values"):
        load_revenue(df).collect()
