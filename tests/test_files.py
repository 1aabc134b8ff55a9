import json
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from retentia.operators import intake
from retentia.sinks import write_csv, write_json, write_text
from retentia.sources import files


@pytest.fixture()
def tmp(tmp_path):
    return str(tmp_path)


def _write(path, data: bytes):
    with open(path, "wb") as fh:
        fh.write(data)
    return path


def test_csv_na_tokens_and_types(spark, tmp):
    p = _write(os.path.join(tmp, "a.csv"), b"id,amount,name,flag\n1,10.5,NA,True\n2,,Bob,False\n3,N/A,null,True\n")
    df = files.scan_csv(spark, p)
    assert dict(df.dtypes) == {"id": "bigint", "amount": "double", "name": "string", "flag": "boolean"}
    rows = df.orderBy("id").collect()
    assert [r["amount"] for r in rows] == [10.5, None, None]
    assert [r["name"] for r in rows] == [None, "Bob", None]


def test_csv_delimiter_and_missing_file(spark, tmp):
    p = _write(os.path.join(tmp, "b.csv"), b"a;b\n1;x\n")
    assert files.scan_csv(spark, p, delimiter=";").first()["b"] == "x"
    with pytest.raises(FileNotFoundError):
        files.scan_csv(spark, os.path.join(tmp, "nope.csv"))
    empty = _write(os.path.join(tmp, "e.csv"), b"")
    with pytest.raises(ValueError):
        files.scan_csv(spark, empty)


def test_latin1_fallback(spark, tmp):
    text = "id,name,city\n1,José,São Paulo\n2,Zoë,Zürich\n"
    _write(os.path.join(tmp, "latin.csv"), text.encode("latin-1"))
    df, enc = files.scan_csv(spark, os.path.join(tmp, "latin.csv"), with_encoding=True)
    assert [r["encoding"] for r in enc.collect()] == ["latin1"]
    assert [r["city"] for r in df.orderBy("id").collect()] == ["São Paulo", "Zürich"]
    _write(os.path.join(tmp, "utf.csv"), text.encode("utf-8"))
    df2, enc2 = files.scan_csv(spark, os.path.join(tmp, "utf.csv"), with_encoding=True)
    assert [r["encoding"] for r in enc2.collect()] == ["utf-8"]
    assert df2.orderBy("id").first()["name"] == "José"


def test_parse_dates(spark, tmp):
    p = _write(os.path.join(tmp, "d.csv"), b"d,v\n2025-01-05,1\nbad,2\n")
    rows = files.scan_csv(spark, p, parse_dates=["d"]).orderBy("v").collect()
    assert rows[0]["d"].isoformat().startswith("2025-01-05") and rows[1]["d"] is None


def test_json_flatten_and_records(spark, tmp):
    doc = [{"user_id": 1, "details": {"tier": "gold", "points": 100}},
           {"user_id": 2, "details": {"tier": "silver", "points": 50}}]
    p = _write(os.path.join(tmp, "n.json"), json.dumps(doc).encode())
    df = files.scan_json(spark, p, flatten=True, multi_line=True)
    assert set(df.columns) == {"user_id", "details_tier", "details_points"}
    assert df.orderBy("user_id").first()["details_tier"] == "gold"
    doc2 = [{"id": 1, "meta": {"src": "a"}, "items": [{"sku": "x", "q": 1}, {"sku": "y", "q": 2}]},
            {"id": 2, "meta": {"src": "b"}, "items": []}]
    p2 = _write(os.path.join(tmp, "r.json"), json.dumps(doc2).encode())
    r = files.scan_json(spark, p2, record_path="items", meta=["id", ["meta", "src"]], multi_line=True)
    assert sorted((x["sku"], x["q"], x["id"], x["meta_src"]) for x in r.collect()) == [("x", 1, 1, "a"), ("y", 2, 1, "a")]


def test_kpi_targets_scan(spark, tmp):
    p = _write(os.path.join(tmp, "t.json"), json.dumps({"churn_rate": {"min": 0, "max": 0.35}}).encode())
    assert [tuple(r) for r in files.scan_kpi_targets(spark, p).collect()] == [("churn_rate", 0.0, 0.35)]


def test_intake_checks(spark, tmp):
    p = _write(os.path.join(tmp, "sample.csv"), b"customer_id,customer_name,transaction_amount,transaction_date\n"
                                                b"1,Alice Smith,150.50,2025-01-15\n2,Bob Johnson,200.00,2025-01-20\n")
    fc = {r["path"]: r for r in intake.file_check(spark, [p, os.path.join(tmp, "missing.csv")]).collect()}
    assert fc[p]["file_exists"] is True and fc[os.path.join(tmp, "missing.csv")]["message"].startswith("File does not exist")
    paths = spark.createDataFrame([("a/b.CSV",), ("x.parquet",), ("noext",)], "path string")
    fmt = {r["path"]: r for r in intake.format_check(paths).collect()}
    assert fmt["a/b.CSV"]["format_valid"] is True and fmt["x.parquet"]["format_valid"] is False
    assert fmt["x.parquet"]["message"] == "Unsupported format: parquet. Allowed: ['csv', 'json', 'xlsx']"
    df = files.scan_csv(spark, p)
    ok, msg = intake.schema_verdict(intake.schema_check(df, ["customer_id", "customer_name", "transaction_amount", "transaction_date"]))
    assert ok and msg == "Schema valid: 4 columns present"
    ok2, msg2 = intake.schema_verdict(intake.schema_check(df, ["customer_id", "extra"]))
    assert not ok2 and msg2.startswith("Missing columns: ['extra'] | Unexpected columns:")
    rep = intake.intake_report(spark, p, ["customer_id", "customer_name", "transaction_amount", "transaction_date"],
                               lambda s, x: files.scan_csv(s, x), "t")
    assert rep.count() == 4
    assert intake.intake_gate(rep).first()["gate"] == "PASS"
    st = intake.dataset_stats(spark, p, df).first()
    assert st["rows"] == 2 and st["columns"] == 4 and st["bytes"] == os.path.getsize(p)
    miss = intake.intake_report(spark, os.path.join(tmp, "gone.csv"), [], None, "t")
    assert miss.count() == 1 and intake.intake_gate(miss).first()["gate"] == "FAIL"


def test_encoding_check(spark, tmp):
    _write(os.path.join(tmp, "bad.csv"), "a\nJosé\n".encode("latin-1"))
    r = intake.encoding_check(spark, os.path.join(tmp, "bad.csv")).first()
    assert r["encoding"] == "unknown" and r["message"] == "Detected: unknown (confidence: 0.0%)"


def test_sinks_round_trip(spark, tmp):
    df = spark.createDataFrame([(1, "a", 1.5), (2, "b", None)], "id int, s string, v double")
    write_csv(df, os.path.join(tmp, "out_csv"))
    back = spark.read.option("header", True).option("inferSchema", True).csv(os.path.join(tmp, "out_csv"))
    assert sorted(tuple(r) for r in back.collect()) == [(1, "a", 1.5), (2, "b", None)]
    write_json(df, os.path.join(tmp, "out_json"), single_file=True)
    assert spark.read.json(os.path.join(tmp, "out_json")).count() == 2
    lines = spark.createDataFrame([(2, "second"), (1, "first")], "line_no int, line string")
    write_text(lines, os.path.join(tmp, "out_txt"), "line", "line_no")
    got = [r[0] for r in spark.read.text(os.path.join(tmp, "out_txt")).collect()]
    assert got == ["first", "second"]


def test_report_bundles(spark, tmp):
    from fixtures import CORRELATION, PROFILES, SEGMENTS
    from retentia.operators import correlation as co
    from retentia.operators import segments as sg
    from retentia.sinks import write_correlation_report, write_segment_report, write_strategy_report
    seg = spark.createDataFrame(SEGMENTS, "customer_id long, customer_type string, product string, revenue bigint, "
                                          "support_tickets bigint, churn bigint")
    p = write_segment_report(sg.segment_metrics(seg), sg.segment_worst_first(seg), sg.revenue_pivot(seg),
                             sg.segment_insights(seg), os.path.join(tmp, "seg"))
    assert spark.read.option("header", True).csv(p["insights_csv"]).count() == 3
    m = {r["customer_type"]: r for r in spark.read.json(p["segment_metrics"]).collect()}
    assert m["Enterprise"]["churn_rate"] == 0.25
    prof = spark.createDataFrame(PROFILES, "customer_id long, customer_type string, lifetime_value bigint, churn bigint, "
                                           "support_tickets bigint, retention_days bigint")
    q = write_strategy_report(sg.strategy_summary(prof), sg.strategy_performers(prof), sg.strategy_narrative(prof),
                              os.path.join(tmp, "strat"))
    lines = [r[0] for r in spark.read.text(q["narrative"]).collect()]
    assert lines[0] == "SEGMENT STRATEGY SUMMARY:" and len(lines) == 7
    cdf = spark.createDataFrame(CORRELATION, "customer_id long, engagement bigint, transactions_per_month bigint, "
                                             "support_tickets bigint, churn bigint")
    c = write_correlation_report(co.pearson_matrix(cdf), co.spearman_matrix(cdf), co.strong_pairs(cdf),
                                 os.path.join(tmp, "corr"))
    assert spark.read.json(c["pearson"]).count() == 16 and spark.read.json(c["strong_pairs"]).count() == 6


def _put(tmp_path, **files_):
    for name, data in files_.items():
        (tmp_path / f"{name}.csv").write_bytes(data if isinstance(data, bytes) else data.encode())
    return str(tmp_path)


def test_csv_quotes_and_line_breaks(spark, tmp_path):
    path = _put(tmp_path, a='id,say\n1,"He said ""hi"" now"\n2,"two\nlines, one field"\n')
    rows = files.scan_csv(spark, path, multi_line=True).orderBy("id").collect()
    assert [tuple(r) for r in rows] == [(1, 'He said "hi" now'), (2, "two\nlines, one field")]


def test_csv_number_suffixes_stay_text(spark, tmp_path):
    df = files.scan_csv(spark, _put(tmp_path, a="code,x\n10d,1.5\n20d,2\n5f,1e3\n"))
    assert dict(df.dtypes) == {"code": "string", "x": "double"}
    assert {r["code"] for r in df.collect()} == {"10d", "20d", "5f"}


def test_csv_headers_in_another_order(spark, tmp_path):
    df = files.scan_csv(spark, _put(tmp_path, one="a,b\n1,x\n", two="b,a\nz,3\n"))
    assert sorted(tuple(r) for r in df.select("a", "b").collect()) == [(1, "x"), (3, "z")]


def test_csv_too_many_fields_fails(spark, tmp_path):
    path = _put(tmp_path, a="a,b\n1,2\n3,4,5,6\n")
    with pytest.raises(Exception, match="more than the 2 fields"):
        files.scan_csv(spark, path, infer_types=False).count()


def test_json_array_and_latin1_with_default_arguments(spark, tmp_path):
    (tmp_path / "a.json").write_text('[\n {"id": 1, "v": {"x": "a"}},\n {"id": 2, "v": {"x": "b"}}\n]')
    got = files.scan_json(spark, str(tmp_path / "a.json"))
    assert sorted(tuple(r) for r in got.select("id", "v_x").collect()) == [(1, "a"), (2, "b")]
    (tmp_path / "b.json").write_bytes('{"id": 1, "n": "Ren\u00e9"}\n{"id": 2, "n": "Zo\u00eb"}\n'.encode("latin1"))
    got, enc = files.scan_json(spark, str(tmp_path / "b.json"), with_encoding=True)
    assert {r["n"] for r in got.collect()} == {"Ren\u00e9", "Zo\u00eb"} and enc.first()["encoding"] == "latin1"


def test_json_documents_and_lines_in_one_folder(spark, tmp_path):
    """Each file is read whole, whichever kind comes first, and encodings are kept apart too."""
    many = 200
    (tmp_path / "a.json").write_text('[\n {"id": 1,\n "v": {"x": "a"}},\n {"id": 2, "v": {"x": "b"}}\n]')
    (tmp_path / "b.json").write_text("\n".join(json.dumps({"id": 10 + i, "w": i}) for i in range(many)) + "\n" * 3)
    (tmp_path / "c.json").write_text("\n \r\n" + '[{"id": 3}, {"id": 4}]\r\n[{"id": 5}]\r\n')
    (tmp_path / "d.json").write_bytes('[\n{"id": 6,\n "n": "Ren\u00e9"}]'.encode("latin1"))
    (tmp_path / "e.json").write_bytes('{"id": 7, "n": "Zo\u00eb"}\n{"id": 8, "n": "\u00fc"}'.encode("latin1"))
    (tmp_path / "f.json").write_text(" \n\n")
    got = files.scan_json(spark, str(tmp_path))
    assert set(got.columns) == {"id", "v_x", "w", "n"}
    rows = {r["id"]: r for r in got.collect()}
    assert got.count() == len(rows) and set(rows) == {*range(1, 9), *range(10, 10 + many)}
    assert (rows[2]["v_x"], rows[11]["w"], rows[6]["n"], rows[8]["n"]) == ("b", 1, "Ren\u00e9", "\u00fc")
    got = files.scan_json(spark, str(tmp_path), encoding="cp1252", schema="id long, n string")
    assert {r["n"] for r in got.collect()} == {None, "Ren\u00e9", "Zo\u00eb", "\u00fc"}


def test_json_lines_of_arrays(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"id": 1}, {"id": 2}]\n[{"id": 3}]\n')
    assert sorted(r["id"] for r in files.scan_json(spark, str(tmp_path / "a.json")).collect()) == [1, 2, 3]


@pytest.mark.parametrize("text", ['{\n"id": 1}\n{\n"id": 2}\n', '{\n"id": 1},\n{"id": 2}', '{"id": 1} {"id": 2}', '{"id": 1}\r{"id": 2}',
                                  '[\n{"id": 1}]\n]\n{"id": 2}'])
def test_json_more_than_one_root_fails(spark, tmp_path, text):
    (tmp_path / "a.json").write_text(text, newline="")
    (tmp_path / "b.json").write_text('{"id": 9}')
    with pytest.raises(ValueError, match="not one JSON value"):
        files.scan_json(spark, str(tmp_path))
    with pytest.raises(ValueError, match="not one JSON value"):
        files.scan_json(spark, str(tmp_path / "a.json"), multi_line=True)


def test_quoted_csv_query_keeps_rows_and_texts(spark, tmp_path):
    from retentia.plans.registry import load_all
    texts = [None, "", " ", " \t ", "a\r\nb", "a\rb", "\r", "\n", "\r\n", "\r\r\n\n", " lead", "trail ", 'q"q', '"', '""', "a,b", "x\0y",
             "\0", "NA", "a\\b", "\\", "#c", "end\r", "\rstart", 'a"\r\n"b', "\x0b"]
    rows = [(i, t, "s" if i % 3 else t) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    got = load_all()["scan_csv_quoted"][0](spark, str(tmp_path)).collect()
    assert sorted(tuple(r) for r in got) == [(i, t or None, s or None) for i, t, s in rows]


def test_queries_do_not_share_staged_files(spark):
    from retentia.plans.registry import load_all
    sf = "/root/testdata/sf0.001"
    first = load_all()["scan_csv"][0](spark, sf)
    second = load_all()["scan_parse_dates"][0](spark, sf)
    assert first.count() == second.count() == first.count()


def _rows(df, *by):
    return [tuple(r) for r in df.orderBy(*by).collect()]


def test_csv_line_breaks_in_quotes_by_default(spark, tmp):
    p = _write(os.path.join(tmp, "q.csv"), b'\n  \nid,note,v\r\n1,"l1\nl2",x\r\n2,"a ""b""\r\n,c\rd",y\n\n3,5" pipe,z\n4,"",\n5,x"y"z,"\n"\n')
    got = _rows(files.scan_csv(spark, p), "id")
    assert got == [(1, "l1\nl2", "x"), (2, 'a "b"\r\n,c\rd', "y"), (3, '5" pipe', "z"), (4, None, None), (5, 'x"y"z', "\n")]


def test_csv_record_starts_in_split_files(spark, tmp):
    """Records longer than a split, quotes and separators at split borders, against the csv module."""
    import csv
    import random
    rng = random.Random(8)
    rows = [["id", "text", "n"]]
    for i in range(400):
        text = "".join(rng.choice(["a", ",", '"', "\n", "\r\n", "\r", " ", "word", "\n\n", '""']) for _ in range(rng.choice([1, 3, 30, 400])))
        rows.append([str(i), "t" + text + "t", rng.choice(["x", "y z"])])
    p = os.path.join(tmp, "split.csv")
    with open(p, "w", newline="") as fh:
        csv.writer(fh, lineterminator="\n").writerows(rows)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1500")
    try:
        assert spark.read.option("lineSep", "\n").text(p).rdd.getNumPartitions() > 20
        got = files.scan_csv(spark, p, na_values=[], infer_types=False).collect()
        flat = files.scan_csv(spark, _write(os.path.join(tmp, "flat.csv"), b"a,b\n" + b"1,x\n" * 2000))
        assert flat.count() == 2000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert sorted(tuple(r) for r in got) == sorted(tuple(r) for r in rows[1:])


def test_csv_folder_of_different_widths(spark, tmp):
    d = os.path.join(tmp, "mixed [1]")
    os.mkdir(d)
    _write(os.path.join(d, "a.csv"), b"a,b\n1,2\n")
    _write(os.path.join(d, "b {x}.csv"), b"a,b,c\n3,4,5\n")
    _write(os.path.join(d, "c.csv"), '\n\nc,"a\nz",b\nü,"n\né\rm",8\n'.encode("latin-1"))
    got = files.scan_csv(spark, d.replace("[", "\\[").replace("]", "\\]"))
    assert got.columns == ["a", "b", "c", "a\nz"]
    assert sorted(map(str, _rows(got, "b"))) == sorted(map(str, [(1, 2, None, None), (3, 4, "5", None), (None, 8, "ü", "n\né\rm")]))


def test_csv_quote_that_never_ends(spark, tmp):
    p = _write(os.path.join(tmp, "open.csv"), b'a,b\n1,"x\n2,y\n')
    with pytest.raises(ValueError, match="never ends"):
        files.scan_csv(spark, p)
    assert files.scan_csv(spark, p, multi_line=False).count() == 2


def test_csv_comment_lines(spark, tmp):
    p = _write(os.path.join(tmp, "com.csv"), b'# "head\na,b\n# it"s\n1,"x\n# y"\n')
    assert _rows(files.scan_csv(spark, p, comment="#"), "a") == [(1, "x\n# y")]


def test_csv_intake_is_one_scan(spark, tmp, monkeypatch):
    """Encoding, header and record starts come from one reading of the lines; Spark's reader then reads the data."""
    p = _write(os.path.join(tmp, "one.csv"), b"a,b\n1,x\n")
    plans = []
    real = files.materialize
    monkeypatch.setattr(files, "materialize", lambda df: (plans.append(df._jdf.queryExecution().executedPlan().toString()), real(df))[1])
    df = files.scan_csv(spark, p, infer_types=False)
    assert [x.count("FileScan text") for x in plans] == [1]
    assert df._jdf.queryExecution().executedPlan().toString().count("FileScan csv") == 1


def test_json_record_path_through_lists_and_structs(spark, tmp):
    """Against pandas: two list levels, a struct level, meta of every level."""
    import pandas as pd
    doc = [{"id": 1, "info": {"x": "p", "a": [{"n": "u", "k": {"z": 1}, "b": [{"v": 1}, {"v": 2}]}, {"n": "w", "k": {"z": 2}, "b": []}]},
            "a": [{"n": "u", "k": {"z": 1}, "b": [{"v": 1}, {"v": 2}]}, {"n": "w", "k": {"z": 2}, "b": [{"v": 3}]}]},
           {"id": 2, "info": {"x": "q", "a": [{"n": "o", "k": {"z": 4}, "b": [{"v": 9}]}]}, "a": [{"n": "o", "k": {"z": 3}, "b": [{"v": 4}]}]}]
    p = _write(os.path.join(tmp, "nested.json"), json.dumps(doc).encode())
    for path, meta in ((["a", "b"], ["id", ["a", "n"], ["a", "k", "z"], ["info", "x"]][:3]), (["info", "a"], ["id", ["info", "x"]]),
                       (["info", "a", "b"], ["id", ["info", "x"], ["info", "a", "n"]]), ("a", ["id", ["info", "x"]])):
        want = pd.json_normalize(doc, record_path=path, meta=meta, sep="_")
        got = files.scan_json(spark, p, record_path=path, meta=meta)
        assert set(got.columns) == set(want.columns)
        want = want[[c for c in want.columns if not isinstance(want[c].iloc[0], list)]]  # lists print differently
        key = lambda r: tuple(map(str, r))
        assert sorted(map(key, got.select(*want.columns).collect())) == sorted(map(key, want.values.tolist()))
