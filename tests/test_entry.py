import importlib.util
import os

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def _entry():
    spec = importlib.util.spec_from_file_location("spark_entry", os.path.join(ROOT, "__spark_entry__.py"))
    mod = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(mod)
    return mod


def test_entry_runs(spark):
    df = _entry().entry(spark)
    rows = df.collect()
    assert len(rows) == 6 and set(df.columns) == {"kpi", "value", "formatted"}


def test_oracle_keys_subset_of_queries():
    m = _entry()
    q, o = m.queries(), m.oracle_sql()
    assert set(o) <= set(q)
    assert len(q) >= 100


@pytest.mark.parametrize("name", ["kpi_all", "dedup_most_complete", "ts_trend", "corr_spearman", "profile_numeric"])
def test_registered_queries_run_on_smoke_data(spark, name):
    df = _entry().queries()[name](spark, "/root/testdata/sf0.001")
    assert df.count() >= 1


def test_scale_conf():
    from retentia.session import scale_conf
    c = scale_conf(100 * (1 << 40))
    assert int(c["spark.sql.shuffle.partitions"]) == 409600
    assert scale_conf(1)["spark.sql.shuffle.partitions"] == "200"


def test_entry_hides_no_import_error(monkeypatch):
    """Only the absence of the optional part itself is let pass."""
    import sys
    if os.path.isdir(os.path.join(ROOT, "retentia", "llm")):
        for name in [m for m in sys.modules if m == "corpus_pipeline" or m.startswith("retentia.llm")]:
            monkeypatch.delitem(sys.modules, name)
        monkeypatch.setitem(sys.modules, "public_tokenizers", None)
        with pytest.raises(ImportError):
            _entry()
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    assert len(_entry().queries()) >= 100
