"""File-source, intake and ingestion queries (S1-S8, V1-V8).

Each query first writes a table (or a frame Spark derives from one) into the
shared staging folder below ``spark.checkpoint.dir`` and then reads it back
through the file operators, so the scan work grows with the tables.
"""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from ..operators import intake, kpi
from ..session import staging_path
from ..sinks import write_csv, write_json
from ..sources import adapters as ad
from ..sources import files
from ..sources.loaders import load_transactions
from . import sql_adapters as S
from .registry import register

AS_OF = "1970-01-01T00:00:00"
ORDER_COLS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]


def _tag(sf):
    return os.path.basename(sf.rstrip("/")) or "sf"


def staged_orders_csv(spark, sf):
    path = staging_path(spark, f"{_tag(sf)}/orders.csv")
    write_csv(ad.table(spark, sf, "orders").select(*ORDER_COLS), path)
    return path


def staged_missing_csv(spark, sf):
    path = staging_path(spark, f"{_tag(sf)}/missing.csv")
    write_csv(ad.missing_orders(spark, sf), path)
    return path


@register("scan_csv", """
SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS o_orderdate,
       o_orderpriority FROM orders""")
def q_scan_csv(spark, sf):
    return files.scan_csv(spark, staged_orders_csv(spark, sf))


@register("scan_parse_dates", "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM orders")
def q_parse_dates(spark, sf):
    return files.scan_csv(spark, staged_orders_csv(spark, sf), parse_dates=["o_orderdate"])


def staged_mixed_encoding(spark, sf):
    base = staging_path(spark, f"{_tag(sf)}/customers_mixed")
    c = ad.table(spark, sf, "customer").select(
        "c_custkey", F.concat(F.lit("Clïent-"), F.col("c_custkey").cast("string")).alias("c_name"), "c_acctbal")
    write_csv(c.filter(F.col("c_custkey") % 2 == 0), f"{base}/utf8")
    (c.filter(F.col("c_custkey") % 2 == 1).write.mode("overwrite").option("header", True)
     .option("encoding", "ISO-8859-1").csv(f"{base}/latin1"))
    return f"{base}/*/*.csv"


@register("scan_csv_encoding_fallback", """
SELECT c_custkey, 'Clïent-' || CAST(c_custkey AS VARCHAR) AS c_name, c_acctbal,
       CASE WHEN c_custkey % 2 = 0 THEN 'utf-8' ELSE 'latin1' END AS encoding FROM customer""")
def q_encoding(spark, sf):
    return files.scan_csv(spark, staged_mixed_encoding(spark, sf), encoding_column="encoding")


@register("scan_json", """
SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders""")
def q_scan_json(spark, sf):
    path = staging_path(spark, f"{_tag(sf)}/orders.json")
    write_json(ad.table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice",
                                                    "o_orderpriority"), path)
    return files.scan_json(spark, path, flatten=False)


@register("json_flatten", """
SELECT event_id, user_id, event_type, value AS event_value, CAST(json_extract(props, '$.k') AS BIGINT) AS event_props_k,
       ts AS event_time_ts FROM events""")
def q_flatten(spark, sf):
    return files.flatten_columns(ad.events_nested(spark, sf), "_")


def staged_event_records(spark, sf):
    path = staging_path(spark, f"{_tag(sf)}/event_records.json")
    e = ad.table(spark, sf, "events")
    rec = e.select("event_id", "user_id", F.array(
        F.struct(F.lit("value").alias("kind"), F.col("value").alias("amount")),
        F.struct(F.lit("k").alias("kind"), F.get_json_object("props", "$.k").cast("double").alias("amount"))
    ).alias("readings"))
    write_json(rec, path)
    return path


@register("json_explode_records", """
SELECT 'value' AS kind, value AS amount, event_id, user_id FROM events
UNION ALL
SELECT 'k', CAST(json_extract(props, '$.k') AS DOUBLE), event_id, user_id FROM events""")
def q_explode(spark, sf):
    return files.scan_json(spark, staged_event_records(spark, sf), record_path="readings", meta=["event_id", "user_id"])


@register("json_explode_nested", """
SELECT l_linenumber, l_quantity, l_orderkey AS order_key, l_suppkey AS suppliers_l_suppkey FROM lineitem""")
def q_explode_nested(spark, sf):
    """Order documents with a list of suppliers, each with a list of lines; meta from the order and from the supplier."""
    lines = ad.table(spark, sf, "lineitem").groupBy("l_orderkey", "l_suppkey").agg(
        F.collect_list(F.struct("l_linenumber", "l_quantity")).alias("lines"))
    doc = lines.groupBy(F.col("l_orderkey").alias("order_key")).agg(F.collect_list(F.struct("l_suppkey", "lines")).alias("suppliers"))
    path = staging_path(spark, f"{_tag(sf)}/order_lines.json")
    write_json(doc, path)
    return files.scan_json(spark, path, record_path=["suppliers", "lines"], meta=["order_key", ["suppliers", "l_suppkey"]])


_KV = S.with_(S.TRANSACTIONS) + """, kv AS (SELECT * FROM (SELECT
   CAST((SELECT count(DISTINCT customer_id) FROM transactions
         WHERE transaction_date >= (SELECT max(transaction_date) FROM transactions) - INTERVAL 30 DAY) AS DOUBLE) AS monthly_active_users,
   (SELECT sum(amount) / count(DISTINCT customer_id) FROM transactions) AS revenue_per_customer,
   (SELECT sum(amount) FROM transactions) AS total_revenue)
 UNPIVOT (value FOR kpi IN (monthly_active_users, revenue_per_customer, total_revenue)))"""


@register("scan_kpi_targets", _KV + """
SELECT kpi, round(value * 0.9, 2) AS min, round(value * 1.1, 2) AS max FROM kv""")
def q_targets(spark, sf):
    vals = kpi.compute_all_kpis(load_transactions(ad.transactions(spark, sf))).filter(
        F.col("kpi").isin("monthly_active_users", "revenue_per_customer", "total_revenue"))
    # Target document in the reference's shape: {kpi: {"min": .., "max": ..}} (one row, one file).
    doc = vals.agg(F.map_from_entries(F.collect_list(F.struct(
        "kpi", F.struct(F.round(F.col("value") * 0.9, 2).alias("min"), F.round(F.col("value") * 1.1, 2).alias("max")))))
        .alias("m"))
    path = staging_path(spark, f"{_tag(sf)}/kpi_targets.json")
    doc.select(F.to_json("m").alias("value")).coalesce(1).write.mode("overwrite").text(path)
    return files.scan_kpi_targets(spark, path)


@register("intake_file_check")
def q_file_check(spark, sf):
    good = staged_orders_csv(spark, sf)
    return intake.file_check(spark, [good, staging_path(spark, f"{_tag(sf)}/does_not_exist.csv")])


@register("intake_format_check", """
SELECT url, lower(regexp_extract(url, '([^.]*)$', 1)) AS extension,
       lower(regexp_extract(url, '([^.]*)$', 1)) IN ('csv', 'json', 'xlsx', 'html') AS format_valid,
       CASE WHEN lower(regexp_extract(url, '([^.]*)$', 1)) IN ('csv', 'json', 'xlsx', 'html')
            THEN 'Format valid: ' || lower(regexp_extract(url, '([^.]*)$', 1))
            ELSE 'Unsupported format: ' || lower(regexp_extract(url, '([^.]*)$', 1)) || '. Allowed: [''csv'', ''json'', ''xlsx'', ''html'']' END AS message
FROM pages""")
def q_format(spark, sf):
    return intake.format_check(ad.table(spark, sf, "pages"), "url", ("csv", "json", "xlsx", "html"))


EXPECTED_ORDERS = ["o_orderkey", "o_custkey", "o_totalprice", "o_orderdate", "o_comment"]


def _observed_sql(columns, expected):
    """Each column's status from the table itself: it counts as present if it holds a value."""
    return " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", CASE WHEN count({c}) > 0 THEN '{'present' if c in expected else 'unexpected'}' "
        f"WHEN {c in expected} THEN 'missing' END AS status FROM orders" if c in columns else
        f"SELECT '{c}', CASE WHEN count(*) >= 0 THEN 'missing' END FROM orders" for c in dict.fromkeys([*columns, *expected]))


@register("intake_schema_check", f"SELECT * FROM ({_observed_sql(ORDER_COLS, EXPECTED_ORDERS)}) WHERE status IS NOT NULL")
def q_schema(spark, sf):
    return intake.schema_check(ad.table(spark, sf, "orders"), EXPECTED_ORDERS, observed=True)


@register("intake_encoding_check")
def q_enc_check(spark, sf):
    return intake.encoding_check(spark, staged_mixed_encoding(spark, sf))


def _reader(spark, path):
    return files.scan_csv(spark, path)


@register("intake_stats")
def q_stats(spark, sf):
    p = staged_orders_csv(spark, sf)
    return intake.dataset_stats(spark, p, files.scan_csv(spark, p))


@register("intake_report")
def q_intake_report(spark, sf):
    return intake.intake_report(spark, staged_orders_csv(spark, sf), ORDER_COLS, _reader, AS_OF)


@register("intake_gate", """
WITH c AS (SELECT 'file_exists' AS "check", count(*) > 0 AS ok FROM orders
  UNION ALL SELECT 'format', count(*) >= 0 FROM orders
  UNION ALL SELECT 'schema', """ + " AND ".join(f"count({c}) > 0" for c in ORDER_COLS) + """ FROM orders
  UNION ALL SELECT 'encoding', count(*) > 0 FROM orders)
SELECT CASE WHEN bool_and(ok) THEN 'PASS' ELSE 'FAIL' END AS gate, count(*) AS checks, count(*) FILTER (WHERE ok) AS passed,
  'Intake validation: ' || CASE WHEN bool_and(ok) THEN 'PASS' ELSE 'FAIL' END AS line FROM c""")
def q_gate(spark, sf):
    return intake.intake_gate(intake.intake_report(spark, staged_orders_csv(spark, sf), ORDER_COLS, _reader, AS_OF))


@register("ingestion_report", S.with_(S.MISSING) + " UNION ALL ".join(
    f"""SELECT {i} AS position, '{c}' AS "column", '{t}' AS dtype, count(*) FILTER (WHERE {c} IS NULL) AS null_count FROM missing"""
    for i, (c, t) in enumerate(zip(ORDER_COLS, ["bigint", "bigint", "string", "double", "string", "string"]))))
def q_ingestion(spark, sf):
    df = files.scan_csv(spark, staged_missing_csv(spark, sf))
    return intake.ingestion_columns(df).withColumn("position", F.col("position").cast("int"))


@register("ingestion_report_nested")
def q_ingestion_nested(spark, sf):
    p = staged_missing_csv(spark, sf)
    df = files.scan_csv(spark, p)
    return intake.ingestion_report(spark, df, p, "csv", "utf-8", ",", False, AS_OF, order_col="o_orderkey")


@register("scan_csv_quoted", "SELECT doc_id, nullif(text, '') AS text, source FROM documents")
def q_scan_quoted(spark, sf):
    """All rows of the documents and their whole texts, staged as CSV and read back with default arguments.

    An empty field is NULL, quoted or not.  Every other text comes back as it was: quotes, commas, white space (also
    alone), NUL, and line breaks inside quotes, of which ``\\r``, ``\\n`` and ``\\r\\n`` stay what they are.
    """
    path = staging_path(spark, f"{_tag(sf)}/texts.csv")
    write_csv(ad.table(spark, sf, "documents").select("doc_id", "text", "source"), path,
              ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return files.scan_csv(spark, path, na_values=[])


@register("scan_csv_mixed_headers", """
SELECT o_orderkey, o_custkey, o_totalprice, CASE WHEN o_orderkey % 3 = 1 THEN o_orderpriority END AS o_orderpriority,
       CASE WHEN o_orderkey % 3 = 2 THEN 'line ' || o_orderstatus || chr(10) || '"' || o_orderpriority || '", end' END AS note FROM orders""")
def q_scan_mixed(spark, sf):
    """A folder of files of two, three and four columns in different orders; one kind has line breaks in quoted fields."""
    base = staging_path(spark, f"{_tag(sf)}/orders_mixed")
    o = ad.table(spark, sf, "orders")
    note = F.concat(F.lit("line "), "o_orderstatus", F.lit('\n"'), "o_orderpriority", F.lit('", end'))
    key = F.col("o_orderkey") % 3
    write_csv(o.where(key == 0).select("o_orderkey", "o_custkey", "o_totalprice"), f"{base}/a")
    write_csv(o.where(key == 1).select("o_totalprice", "o_orderkey", "o_custkey", "o_orderpriority"), f"{base}/b")
    write_csv(o.where(key == 2).select("o_orderkey", note.alias("note"), "o_custkey", "o_totalprice"), f"{base}/c")
    return files.scan_csv(spark, f"{base}/*/*.csv")
