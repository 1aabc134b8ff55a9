import datetime as dt

from pyspark.sql import functions as F

from fixtures import UNSTANDARDISED
from retentia.functions.text import py_strip, py_title, strftime_to_spark
from retentia.operators import standardise as st


def _one(spark, values, expr, dtype="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {dtype}")
    return [r[0] for r in df.orderBy("i").select(expr(F.col("v"))).collect()]


def test_dates_strict(spark):
    out = _one(spark, ["2031-12-31", "1999-06-07", "31.12.2031"], st.standardise_datetime)
    assert out == [dt.datetime(2031, 12, 31), dt.datetime(1999, 6, 7), None]


def test_date_quirks(spark):
    out = _one(spark, ["2025-1-5", "2025-02-30", "20250115", "2025-01-15 10:00", " 2025-03-01 ", "nan", ""],
               st.standardise_datetime)
    assert out[0] == dt.datetime(2025, 1, 5)
    assert out[1:4] == [None, None, None]
    assert out[4] == dt.datetime(2025, 3, 1)
    assert out[5:] == [None, None]


def test_strftime_mapping():
    assert strftime_to_spark("%Y-%m-%d") == "yyyy-M-d"
    assert strftime_to_spark("%d/%m/%Y %H:%M") == "d/M/yyyy H:m"
    assert strftime_to_spark("%Y%m%dT") == "yyyyMd'T'"


def test_currency(spark):
    out = _one(spark, [None, "7,001.25 EUR", "$-3", "--", "\t$ 0.10\n"], st.standardise_numeric)
    assert out == [None, 7001.25, -3.0, None, 0.1]


def test_numeric_deletes_letters(spark):
    assert _one(spark, ["1e5", "€3", "£2,000", "12 kg"], st.standardise_numeric) == [15.0, 3.0, 2000.0, 12.0]


def test_large_integers_are_exact(spark):
    values = ["9007199254740993", "9223372036854775807", "-9223372036854775808", "1e3"]
    out = _one(spark, values, lambda c: st.standardise_numeric(c, "int"))
    assert out == [9007199254740993, 9223372036854775807, -9223372036854775808, 13]


def test_integer_target(spark):
    assert _one(spark, ["12.9", "$7", "x"], lambda c: st.standardise_numeric(c, "int")) == [12, 7, None]


def test_booleans(spark):
    out = _one(spark, ["NO", "perhaps", " Yes", "TRUE ", "f", None], st.standardise_boolean)
    assert out == [False, None, True, True, False, None]


def test_boolean_from_double_fails_like_pandas(spark):
    assert _one(spark, [1.0, 0.0], st.standardise_boolean, "double") == [None, None]
    assert _one(spark, [1, 0], st.standardise_boolean, "int") == [True, False]


def test_python_title_and_strip(spark):
    out = _one(spark, ["  o'neil  ", "3rd place", "BASIC", "\tmixed "], lambda c: py_title(py_strip(c)))
    assert out == ["O'Neil", "3Rd Place", "Basic", "Mixed"]


def test_string_tokens(spark):
    out = _one(spark, [" a ", "nan", "None", ""], lambda c: st.standardise_string(c, "upper"))
    assert out == ["A", None, None, ""]


SPEC = {
    "signup_date": {"type": "datetime", "format": "%Y-%m-%d"},
    "monthly_fee": {"type": "currency"},
    "watch_duration": {"type": "float"},
    "auto_renew": {"type": "boolean"},
    "churn": {"type": "int"},
    "plan": {"type": "string", "case": "title"},
    "user_name": {"type": "string"},
    "absent": {"type": "float"},
    "viewer_id": {"type": "mystery"},
}


def _raw(spark):
    return spark.createDataFrame([(i,) + r for i, r in enumerate(UNSTANDARDISED)],
                                 "row_id long, viewer_id string, user_name string, signup_date string, monthly_fee string, "
                                 "watch_duration string, auto_renew string, churn string, plan string")


def test_enforce_schema_golden(spark):
    out = st.enforce_dataset_schema(_raw(spark), SPEC).orderBy("row_id").collect()
    assert [r["user_name"] for r in out][:2] == ["Alice Johnson", "Bob Smith"]
    assert [r["monthly_fee"] for r in out] == [15.99, 11.99, 8.99, 15.99, 1200.5, 11.99, 15.99, 8.99]
    assert [r["auto_renew"] for r in out] == [True, True, False, True, True, False, False, True]
    assert [r["plan"] for r in out] == ["Premium", "Standard", "Basic", "Premium", "Standard", "Standard", "Premium", "Basic"]
    assert out[0]["signup_date"] == dt.datetime(2025, 1, 10)
    assert [r["churn"] for r in out] == [0, 0, 1, 0, 0, 1, 0, 0]
    assert out[0]["viewer_id"] == "V101"


def test_conversion_audit(spark):
    raw = _raw(spark).withColumn("auto_renew", F.when(F.col("row_id") == 2, "maybe").otherwise(F.col("auto_renew")))
    a = {r["column"]: r for r in st.conversion_audit(raw, SPEC).collect()}
    assert "absent" not in a
    assert a["auto_renew"]["failed_conversions"] == 1 and a["auto_renew"]["success_rate_pct"] == 87.5
    assert a["monthly_fee"]["is_currency"] is True and a["monthly_fee"]["final_dtype"] == "double"
    assert a["viewer_id"]["status"] == "skipped"
    f = st.sample_failures(raw, SPEC, "row_id").collect()
    assert [(r["column"], r["row_index"], r["raw_value"]) for r in f] == [("auto_renew", 2, "maybe")]


def test_raise_mode(spark):
    import pytest
    df = spark.createDataFrame([("2025-01-01",), ("bad",)], "v string")
    with pytest.raises(Exception, match="unparseable datetime"):
        df.select(st.standardise_datetime("v", errors="raise")).collect()
    with pytest.raises(Exception, match="neither a true nor a false value"):
        spark.createDataFrame([("yes",), ("maybe",)], "v string").select(
            st.standardise_boolean("v", errors="raise")).collect()
    with pytest.raises(Exception, match="unparseable number"):
        spark.createDataFrame([("1.2.3",)], "v string").select(st.standardise_numeric("v", errors="raise")).collect()


def test_table_and_audit_from_one_pass(spark, tmp_path):
    """Every row is computed once, and table and audit equal those of the two separate operators."""
    spec = {"in0": {"type": "int"}, "c0": {"type": "currency"}, "given0": {"type": "what"}, "absent": {"type": "float"}}
    rows = [("7", "$1,000", "a", 1), ("x", None, None, 2), (None, "n/a", "b", 3), ("nan", "", "", None)] * 50
    raw = spark.createDataFrame(rows, "in0 string, c0 string, given0 string, other int").repartition(7)
    passed = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            passed.add(batch.num_rows)
            yield batch

    table, audit = st.standardise_dataset(raw.mapInArrow(count, raw.schema), spec, str(tmp_path / "t"))
    assert table.columns == raw.columns and table.count() == 200 and passed.value == 200
    key = lambda r: str(tuple(r))
    assert sorted(table.collect(), key=key) == sorted(st.enforce_dataset_schema(raw, spec).collect(), key=key)
    assert audit.orderBy("column").collect() == st.conversion_audit(raw, spec).orderBy("column").collect()
    assert passed.value == 200


def test_table_and_audit_of_nothing(spark):
    empty = spark.createDataFrame([], "v string")
    table, audit = st.standardise_dataset(empty, {"v": {"type": "float"}})
    assert table.count() == 0 and table.schema["v"].dataType.simpleString() == "double"
    assert [(r.total_inputs, r.success_rate_pct) for r in audit.collect()] == [(0, 0.0)]
    table, audit = st.standardise_dataset(spark.range(3).toDF("v"), {"w": {"type": "int"}})
    assert table.count() == 3 and audit.count() == 0
