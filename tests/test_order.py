"""Bucketed-prefix helpers against pandas on random inputs (including a hot bucket)."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from retentia.functions.order import forward_fill, row_index, running_sum
from retentia.functions.stats import exact_quantiles, mode_value


@pytest.mark.parametrize("seed", [0, 1])
def test_running_sum_and_index(spark, seed):
    rnd = random.Random(seed)
    rows = [(i, rnd.choice([0, 0, 0, 1, 2, 3]), float(rnd.randint(-50, 50))) for i in range(500)]
    df = spark.createDataFrame(rows, "id long, g int, v double")
    order = [F.col("g"), F.col("id")]
    bucket = F.struct(F.col("g").alias("g"), F.floor(F.col("id") / 64).alias("b"))   # g=0 is a hot group
    got = {r["id"]: (r["cs"], r["ix"]) for r in
           row_index(running_sum(df, "v", "cs", order, bucket), "ix", order, bucket).collect()}
    pdf = pd.DataFrame(rows, columns=["id", "g", "v"]).sort_values(["g", "id"])
    pdf["cs"] = pdf["v"].cumsum()
    pdf["ix"] = range(len(pdf))
    for _, r in pdf.iterrows():
        assert got[r["id"]][0] == pytest.approx(r["cs"]) and got[r["id"]][1] == r["ix"]


def test_forward_fill_all_null_and_leading(spark):
    df = spark.createDataFrame([(0, None, None), (1, None, 5.0), (2, None, None), (3, None, 7.0)], "id long, a double, b double")
    out = {r["id"]: (r["a"], r["b"]) for r in forward_fill(df, ["a", "b"], [F.col("id")], F.floor(F.col("id") / 2)).collect()}
    assert out == {0: (None, 5.0), 1: (None, 5.0), 2: (None, 5.0), 3: (None, 7.0)}


def test_grouped_quantiles_and_mode_with_hot_value(spark):
    rnd = random.Random(5)
    rows = [("a", 1.0)] * 300 + [("a", float(rnd.randint(0, 9))) for _ in range(200)] + \
           [("b", float(rnd.randint(0, 99))) for _ in range(77)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r["g"]: (r["p10"], r["p50"], r["p95"]) for r in
           exact_quantiles(df, "v", [0.1, 0.5, 0.95], group="g", names=["p10", "p50", "p95"]).collect()}
    pdf = pd.DataFrame(rows, columns=["g", "v"])
    for g, s in pdf.groupby("g")["v"]:
        assert got[g] == pytest.approx(tuple(s.quantile([0.1, 0.5, 0.95])))
    m = {r["g"]: r["mode"] for r in mode_value(df, "v", group="g").collect()}
    assert m["a"] == 1.0
    assert m["b"] == min(pdf[pdf.g == "b"]["v"].mode())


def test_quantiles_equal_numpy(spark):
    import numpy as np
    import retentia.functions.stats as S
    rnd = random.Random(11)
    rows = [("a", float(rnd.randint(0, 30))) for _ in range(400)] + [("a", 3.0)] * 200 + \
           [("b", rnd.random()) for _ in range(101)]
    df = spark.createDataFrame(rows, "g string, v double")
    qs = [0.0, 0.25, 0.5, 0.9, 1.0]
    names = [f"q{i}" for i in range(len(qs))]
    got = {r["g"]: [r[n] for n in names] for r in S.exact_quantiles(df, "v", qs, group="g", names=names).collect()}
    for g in ("a", "b"):
        vals = np.array([v for k, v in rows if k == g])
        assert got[g] == pytest.approx(list(np.quantile(vals, qs)))
    glob = S.exact_quantiles(df, "v", qs, names=names).first()
    assert [glob[n] for n in names] == pytest.approx(list(np.quantile(np.array([v for _, v in rows]), qs)))
    w = spark.createDataFrame([(1.0, 3), (2.0, 1), (5.0, 2)], "v double, c long")
    assert S.exact_quantiles(w, "v", [0.5], names=["m"], weight="c").first()["m"] == pytest.approx(
        float(np.median([1, 1, 1, 2, 5, 5])))


def test_quantiles_over_every_magnitude(spark):
    """Signs, zeros, infinities, subnormal numbers, neighbouring doubles and a hot value, against numpy."""
    import numpy as np
    import retentia.functions.stats as S
    rnd = random.Random(5)
    wild = [rnd.choice((-1, 1)) * rnd.random() * 10.0 ** rnd.randint(-320, 300) for _ in range(3000)]
    close = [1.0 + k * 2.0 ** -52 for k in range(1, 501)]
    hot = [7.5] * 1500 + [rnd.gauss(0, 1) for _ in range(1500)]
    edge = [0.0, -0.0, 5e-324, -5e-324, 1.0, 1.0, -1.0]
    cols = {"wild": wild, "close": close, "hot": hot, "edge": edge}
    n = max(map(len, cols.values()))
    rows = [tuple(v[i] if i < len(v) else (None if i % 2 else float("nan")) for v in cols.values()) for i in range(n)]
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in cols)).repartition(7)
    qs = [0.0, 0.001, 0.25, 0.5, 0.77, 0.999, 1.0]
    got = S.column_quantiles(df, list(cols), qs)
    for c, vals in cols.items():
        assert got[c] == pytest.approx([float(np.quantile(np.array(vals), q)) for q in qs], rel=1e-12, abs=5e-324), c
    long_ = df.selectExpr("stack(4, " + ", ".join(f"'{c}', {c}" for c in cols) + ") AS (g, v)")
    long_ = long_.unionByName(spark.createDataFrame([(None, 2.0), (None, 4.0)], "g string, v double"))
    names = [f"q{i}" for i in range(len(qs))]
    by_group = {r["g"]: [r[x] for x in names] for r in S.exact_quantiles(long_, "v", qs, group="g", names=names).collect()}
    assert by_group.pop(None)[3] == 3.0
    assert by_group == got
    inf = spark.createDataFrame([(float("-inf"),), (1.0,), (float("inf"),), (float("inf"),)], "v double")
    assert S.quantile_values(inf, "v", [0.0, 1 / 3, 1.0]) == [float("-inf"), 1.0, float("inf")]
    assert S.column_quantiles(df.where("false"), ["hot", "edge"], [0.5]) == {"hot": [None], "edge": [None]}


def test_selection_sorts_and_stores_no_rows(spark, monkeypatch):
    """Every round is a partial aggregate; what is shuffled is at most one row per bucket and task."""
    import retentia.functions.stats as S
    seen = []
    whole = S._buckets

    def watched(rows, keys):
        out = whole(rows, keys)
        seen.append(out._jdf.queryExecution().optimizedPlan().toString())
        return out

    monkeypatch.setattr(S, "_buckets", watched)
    df = spark.range(20000).selectExpr("cast(hash(id) as double) / 7 AS v")
    S.quantile_values(df, "v", [0.25, 0.5, 0.75])
    assert 2 <= len(seen) <= 5
    assert not any("RepartitionByExpression" in p or "Sort " in p for p in seen)


def test_forward_fill_summary_is_bounded_by_partitions(spark):
    """Every date spans many id blocks; the carry still has one row per range partition at most."""
    from retentia.functions.order import BUCKET, ranged
    rows = [(i, i % 5, float(i) if i % 3 == 0 else None) for i in range(4000)]
    df = spark.createDataFrame(rows, "id long, d int, v double")
    order = [F.col("d").isNull(), F.col("d"), F.col("id")]
    assert ranged(df, order).select(BUCKET).distinct().count() <= int(spark.conf.get("spark.sql.shuffle.partitions"))
    got = {r["id"]: r["v"] for r in forward_fill(df, "v", order).collect()}
    pdf = pd.DataFrame(rows, columns=["id", "d", "v"]).sort_values(["d", "id"])
    pdf["v"] = pdf["v"].ffill().bfill()
    assert got == dict(zip(pdf["id"], pdf["v"]))
