import datetime as dt

import pytest

from fixtures import DUPLICATES
from retentia.operators import dedup

KEYS = ["viewer_id", "content_id", "watch_date"]


def _frame(spark):
    rows = [(i, a, b, c, dt.date.fromisoformat(d_), e, f, g) for i, (a, b, c, d_, e, f, g) in enumerate(DUPLICATES)]
    return spark.createDataFrame(rows, "row_id long, viewer_id string, user_name string, content_id string, watch_date date, "
                                       "watch_duration double, completion_rate double, subscription_status string")


def test_exact_and_key_stats(spark):
    ex = dedup.exact_duplicate_stats(_frame(spark)).first()
    assert ex["exact_duplicate_rows"] == 2 and ex["total_rows_involved"] == 4 and ex["exact_duplicate_pct"] == 20.0
    near = dedup.key_duplicate_stats(_frame(spark), KEYS).first()
    # exact copies count as key duplicates too
    assert near["key_duplicate_rows"] == 4 and near["key_duplicate_pct"] == 40.0


def test_unknown_key_raises(spark):
    with pytest.raises(ValueError):
        dedup.key_duplicate_stats(_frame(spark), ["nope"])


def test_most_complete_golden(spark):
    kept, removed = dedup.deduplicate(_frame(spark), "most_complete", KEYS)
    rows = kept.orderBy("row_id").collect()
    assert [r["viewer_id"] for r in rows] == ["V101", "V102", "V103", "V104", "V105", "V106"]
    by = {r["viewer_id"]: r for r in rows}
    assert by["V104"]["watch_duration"] == 60.0
    assert by["V102"]["completion_rate"] == 0.4
    m = dedup.dedup_metrics(_frame(spark), kept, "most_complete", KEYS).first()
    assert (m["rows_before"], m["rows_after"], m["records_removed"], m["percentage_removed"]) == (10, 6, 4, 40.0)
    audit = dedup.removed_audit(removed, "most_complete", KEYS, "t").orderBy("_orig_idx").collect()
    assert [r["_orig_idx"] for r in audit] == [1, 3, 6, 8]
    assert audit[0]["business_keys_used"] == "viewer_id, content_id, watch_date"


def test_first_last_with_sort(spark):
    kept, _ = dedup.deduplicate(_frame(spark), "last", KEYS)
    assert {r["viewer_id"]: r["row_id"] for r in kept.collect()}["V104"] == 6
    kept, _ = dedup.deduplicate(_frame(spark), "first", KEYS, sort_by="watch_duration", ascending=False)
    assert {r["viewer_id"]: r["watch_duration"] for r in kept.collect()}["V104"] == 65.0
    kept, _ = dedup.deduplicate(_frame(spark), "last", KEYS, sort_by="completion_rate")
    # nulls sort last, so the last row of V102 is the one with the NULL rate
    assert {r["viewer_id"]: r["row_id"] for r in kept.collect()}["V102"] == 3


def test_exact_dedup_and_bad_strategy(spark):
    assert dedup.exact_dedup(_frame(spark)).count() == 8
    with pytest.raises(ValueError):
        dedup.deduplicate(_frame(spark), "median", KEYS)


def test_hot_key_plan_has_partial_group_limit(spark):
    kept, _ = dedup.deduplicate(_frame(spark), "most_complete", KEYS)
    plan = kept._jdf.queryExecution().executedPlan().toString()
    # the limit runs before the shuffle (partial) and after it (final)
    assert plan.count("WindowGroupLimit") >= 2


def test_hot_key_third_of_rows(spark):
    from pyspark.sql import functions as F
    base = spark.range(3000).select(F.col("id").alias("row_id"),
                                    F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id")).alias("k"),
                                    (F.col("id") * 7 % 11).cast("double").alias("v"))
    kept, removed = dedup.deduplicate(base, "first", ["k"], sort_by="v")
    assert kept.count() == 2001 and removed.count() == 999
    hot = kept.filter("k = 0").first()
    assert hot["v"] == 0.0 and hot["row_id"] == 0
