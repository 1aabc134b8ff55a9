"""The report writers: every file is written and reads back."""

from retentia import sinks
from retentia.operators import dedup, distribution, kpi, missing, timeseries
from retentia.sources import adapters as ad
from retentia.sources.loaders import load_revenue, load_time_series, load_transactions

SF = "/root/testdata/sf0.001"


def test_kpi_run(spark, tmp_path):
    tx = load_transactions(ad.transactions(spark, SF))
    values = kpi.compute_all_kpis(tx)
    paths = sinks.write_kpi_run(values, kpi.validate_against_targets(values, kpi.default_targets(spark)),
                                kpi.decompose_total_revenue(tx), str(tmp_path))
    assert spark.read.option("header", True).csv(paths["validation"]).count() == 6
    assert spark.read.json(paths["values"]).count() == 6
    rows = spark.read.json(paths["decomposition"]).where("breakdown = 'segment'").orderBy("rank").collect()
    assert [r["revenue"] for r in rows] == sorted((r["revenue"] for r in rows), reverse=True) and len(rows) > 1


def test_time_series_and_distribution_reports(spark, tmp_path):
    ts = load_time_series(ad.daily_revenue(spark, SF))
    paths = sinks.write_time_series_report(timeseries.weekly(ts), timeseries.monthly(ts), timeseries.growth_decline(ts),
                                           timeseries.highest_month(ts), timeseries.trend(ts), str(tmp_path / "ts"))
    assert spark.read.json(paths["monthly"]).count() == timeseries.monthly(ts).count()
    assert spark.read.json(paths["highest_month"]).count() == spark.read.json(paths["trend"]).count() == 1
    rev = load_revenue(ad.sample_transactions(spark, SF).withColumnRenamed("transaction_amount", "revenue"))
    paths = sinks.write_distribution_report(distribution.describe(rev), distribution.percentiles(rev), distribution.shape(rev),
                                            distribution.value_segments(rev), distribution.interpretation(rev), str(tmp_path / "d"))
    assert all(spark.read.json(p).count() >= 1 for p in paths.values()) and len(paths) == 5


def test_imputation_and_dedup_outputs(spark, tmp_path):
    raw = ad.missing_orders(spark, SF)
    done, log = missing.handle_missing_values(raw, ["o_custkey"], ["o_totalprice"], ["o_orderpriority"], ["o_orderdate"],
                                              "o_orderdate", order_col="o_orderkey")
    paths = sinks.write_imputation_outputs(done, log, missing.imputation_report(raw, done), str(tmp_path / "m"))
    assert spark.read.option("header", True).csv(paths["cleaned"]).count() == done.count()
    assert spark.read.json(paths["log"]).count() == 4
    rows, keys = ad.duplicated_orders(spark, SF), ["o_custkey", "o_orderdate"]
    kept = dedup.deduplicate(rows, "most_complete", keys)
    kept, removed = kept if isinstance(kept, tuple) else (kept, rows.join(kept, "row_id", "left_anti"))
    report = dedup.dedup_report(dedup.dedup_metrics(rows, kept, "most_complete", keys),
                                dedup.exact_duplicate_stats(rows), "1970-01-01T00:00:00")
    paths = sinks.write_dedup_outputs(kept, removed, report, str(tmp_path / "x"))
    written = [spark.read.option("header", True).csv(paths[k]).count() for k in ("kept", "removed")]
    assert sum(written) == rows.count() and min(written) > 0
