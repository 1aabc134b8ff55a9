"""Standardisation queries (S3, T1-T8) over the ``unstandardised`` adapter."""

from __future__ import annotations

from ..functions.text import NA_TOKENS, na_to_null
from ..operators import standardise as st
from ..sources import adapters as ad
from . import sql_adapters as S
from .registry import register

U = S.with_(S.UNSTD)

SPEC = {
    "order_id": {"type": "int"},
    "order_date": {"type": "datetime", "format": "%Y-%m-%d"},
    "total_price": {"type": "currency"},
    "auto_renew": {"type": "boolean"},
    "priority": {"type": "string", "case": "title"},
    "status": {"type": "string", "case": "lower"},
    "not_in_frame": {"type": "float"},
}


def _strip(x):
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def sql_dt(x):
    s = _strip(x)
    return f"CAST(try_strptime(CASE WHEN {s} IN ('nan', 'None', '') THEN NULL ELSE {s} END, '%Y-%m-%d') AS TIMESTAMP)"


def sql_num(x):
    s = _strip(f"regexp_replace(replace(regexp_replace({_strip(x)}, '[$,€£₹]', '', 'g'), ',', ''), '[a-zA-Z]+', '', 'g')")
    return f"(CASE WHEN {s} IN ('', 'nan', 'None') THEN NULL ELSE TRY_CAST({s} AS DOUBLE) END)"


def sql_int(x):
    return f"CAST(trunc({sql_num(x)}) AS BIGINT)"


def sql_bool(x):
    s = f"lower({_strip(x)})"
    return (f"(CASE WHEN {s} IN ('1','true','t','yes','y') THEN true "
            f"WHEN {s} IN ('0','false','f','no','n') THEN false END)")


def sql_title(x):
    s = _strip(x)
    s = f"(CASE WHEN {s} IN ('nan', 'None') THEN NULL ELSE {s} END)"
    return (rf"array_to_string(list_transform(regexp_extract_all({s}, '(\p{{L}}+|[^\p{{L}}]+)'), "
            f"lambda r: upper(r[1]) || lower(r[2:])), '')")


def sql_lower(x):
    s = _strip(x)
    return f"lower(CASE WHEN {s} IN ('nan', 'None') THEN NULL ELSE {s} END)"


def raw(spark, sf):
    return ad.unstandardised_orders(spark, sf)


_TOKENS = ", ".join("'" + t.replace("'", "''") + "'" for t in NA_TOKENS)


@register("na_token_normalise", U + f"""
SELECT row_id, CASE WHEN total_price IN ({_TOKENS}) THEN NULL ELSE total_price END AS total_price,
       CASE WHEN order_date IN ({_TOKENS}) THEN NULL ELSE order_date END AS order_date FROM unstd""")
def q_na_tokens(spark, sf):
    r = raw(spark, sf)
    return r.select("row_id", na_to_null("total_price").alias("total_price"), na_to_null("order_date").alias("order_date"))


@register("std_datetime", U + f"SELECT row_id, {sql_dt('order_date')} AS order_date FROM unstd")
def q_std_datetime(spark, sf):
    return raw(spark, sf).select("row_id", st.standardise_datetime("order_date", "%Y-%m-%d").alias("order_date"))


@register("std_numeric", U + f"SELECT row_id, {sql_num('total_price')} AS total_price FROM unstd")
def q_std_numeric(spark, sf):
    return raw(spark, sf).select("row_id", st.standardise_numeric("total_price").alias("total_price"))


@register("std_integer", U + f"SELECT row_id, {sql_int('total_price')} AS total_price, {sql_int('order_id')} AS order_id FROM unstd")
def q_std_integer(spark, sf):
    r = raw(spark, sf)
    return r.select("row_id", st.standardise_numeric("total_price", "int").alias("total_price"),
                    st.standardise_numeric("order_id", "int").alias("order_id"))


@register("std_boolean", U + f"SELECT row_id, {sql_bool('auto_renew')} AS auto_renew FROM unstd")
def q_std_boolean(spark, sf):
    return raw(spark, sf).select("row_id", st.standardise_boolean("auto_renew").alias("auto_renew"))


@register("std_string", U + f"SELECT row_id, {sql_title('priority')} AS priority, {sql_lower('status')} AS status FROM unstd")
def q_std_string(spark, sf):
    r = raw(spark, sf)
    return r.select("row_id", st.standardise_string("priority", "title").alias("priority"),
                    st.standardise_string("status", "lower").alias("status"))


_ENFORCED = U + f"""
SELECT row_id, {sql_int('order_id')} AS order_id, {sql_dt('order_date')} AS order_date,
       {sql_num('total_price')} AS total_price, {sql_bool('auto_renew')} AS auto_renew,
       {sql_title('priority')} AS priority, {sql_lower('status')} AS status FROM unstd"""


@register("std_enforce_schema", _ENFORCED)
def q_enforce(spark, sf):
    return st.enforce_dataset_schema(raw(spark, sf), SPEC)


def _audit_sql():
    parts = []
    for c, conv, target, final, cur in [
        ("order_id", sql_int("order_id"), "int", "bigint", False),
        ("order_date", sql_dt("order_date"), "datetime", "timestamp_ntz", False),
        ("total_price", sql_num("total_price"), "float", "double", True),
        ("auto_renew", sql_bool("auto_renew"), "boolean", "boolean", False),
        ("priority", sql_title("priority"), "string", "string", False),
        ("status", sql_lower("status"), "string", "string", False),
    ]:
        parts.append(f"""SELECT '{c}' AS "column", '{target}' AS target_type, 'converted' AS status,
  'string' AS initial_dtype, '{final}' AS final_dtype, {str(cur).lower()} AS is_currency,
  count({c}) AS total_inputs, count({conv}) AS successful_conversions FROM unstd""")
    body = "\nUNION ALL\n".join(parts)
    return U + f"""SELECT *, total_inputs - successful_conversions AS failed_conversions,
  round(successful_conversions / greatest(total_inputs, 1) * 100, 2) AS success_rate_pct FROM ({body})"""


@register("std_conversion_audit", _audit_sql())
def q_audit(spark, sf):
    return st.conversion_audit(raw(spark, sf), SPEC)


@register("std_dataset", _ENFORCED)
def q_dataset(spark, sf):
    return st.standardise_dataset(raw(spark, sf), SPEC)[0]


@register("std_dataset_audit", _audit_sql())
def q_dataset_audit(spark, sf):
    return st.standardise_dataset(raw(spark, sf), SPEC)[1]


def _failures_sql():
    parts = []
    for c, conv in [("order_id", sql_int("order_id")), ("order_date", sql_dt("order_date")),
                    ("total_price", sql_num("total_price")), ("auto_renew", sql_bool("auto_renew")),
                    ("priority", sql_title("priority")), ("status", sql_lower("status"))]:
        parts.append(f"""SELECT '{c}' AS "column", row_id AS row_index, CAST({c} AS VARCHAR) AS raw_value
  FROM unstd WHERE {c} IS NOT NULL AND {conv} IS NULL""")
    body = "\nUNION ALL\n".join(parts)
    return U + f"""SELECT "column", CAST(sample_rank AS INTEGER) AS sample_rank, row_index, raw_value FROM (
  SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY row_index) AS sample_rank FROM ({body}))
WHERE sample_rank <= 5"""


@register("std_sample_failures", _failures_sql())
def q_failures(spark, sf):
    return st.sample_failures(raw(spark, sf), SPEC, "row_id", 5)
