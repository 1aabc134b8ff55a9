"""Duplicate queries (D1-D9) over the ``duplicates`` adapter."""

from __future__ import annotations

from ..operators import dedup
from ..sources import adapters as ad
from . import sql_adapters as S
from .registry import register

D = S.with_(S.DUPS)
DATA = "o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority"
KEYS = ["o_custkey", "o_orderdate"]
AS_OF = "1970-01-01T00:00:00"


def raw(spark, sf):
    return ad.duplicated_orders(spark, sf)


@register("dup_exact_stats", D + f"""
SELECT CAST(sum(n - 1) AS BIGINT) AS exact_duplicate_rows,
       round(sum(n - 1) / greatest(sum(n), 1) * 100, 2) AS exact_duplicate_pct,
       sum(n - 1) > 0 AS has_exact_duplicates,
       CAST(sum(CASE WHEN n > 1 THEN n ELSE 0 END) AS BIGINT) AS total_rows_involved
FROM (SELECT count(*) AS n FROM dups GROUP BY {DATA})""")
def q_exact_stats(spark, sf):
    return dedup.exact_duplicate_stats(raw(spark, sf))


@register("dup_key_stats", D + """
SELECT 'o_custkey, o_orderdate' AS business_keys, CAST(sum(n - 1) AS BIGINT) AS key_duplicate_rows,
       round(sum(n - 1) / greatest(sum(n), 1) * 100, 2) AS key_duplicate_pct, sum(n - 1) > 0 AS has_near_duplicates
FROM (SELECT count(*) AS n FROM dups GROUP BY o_custkey, o_orderdate)""")
def q_key_stats(spark, sf):
    return dedup.key_duplicate_stats(raw(spark, sf), KEYS)


def _ranked(order):
    return f"""ranked AS (SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderdate ORDER BY {order}) AS rn FROM dups)"""


_FIRST = "o_totalprice ASC NULLS LAST, row_id"
_LAST = "o_totalprice DESC NULLS FIRST, row_id DESC"
_COMPLETE = ("(CAST(o_orderkey IS NOT NULL AS INT) + CAST(o_custkey IS NOT NULL AS INT) + "
             "CAST(o_orderstatus IS NOT NULL AS INT) + CAST(o_totalprice IS NOT NULL AS INT) + "
             "CAST(o_orderdate IS NOT NULL AS INT) + CAST(o_orderpriority IS NOT NULL AS INT)) DESC, row_id")


@register("dedup_first", S.with_(S.DUPS, _ranked(_FIRST)) + "SELECT * EXCLUDE (rn) FROM ranked WHERE rn = 1")
def q_first(spark, sf):
    return dedup.deduplicate(raw(spark, sf), "first", KEYS, sort_by="o_totalprice")[0]


@register("dedup_last", S.with_(S.DUPS, _ranked(_LAST)) + "SELECT * EXCLUDE (rn) FROM ranked WHERE rn = 1")
def q_last(spark, sf):
    return dedup.deduplicate(raw(spark, sf), "last", KEYS, sort_by="o_totalprice")[0]


@register("dedup_most_complete", S.with_(S.DUPS, _ranked(_COMPLETE)) + "SELECT * EXCLUDE (rn) FROM ranked WHERE rn = 1")
def q_most_complete(spark, sf):
    return dedup.deduplicate(raw(spark, sf), "most_complete", KEYS)[0]


@register("dedup_exact", D + f"SELECT {DATA}, min(row_id) AS row_id FROM dups GROUP BY {DATA}")
def q_exact(spark, sf):
    return dedup.exact_dedup(raw(spark, sf))


@register("dedup_removed_audit", S.with_(S.DUPS, _ranked(_COMPLETE)) + f"""
SELECT {DATA}, row_id AS _orig_idx, 'most_complete' AS dedup_strategy,
       'o_custkey, o_orderdate' AS business_keys_used, '{AS_OF}' AS removal_timestamp
FROM ranked WHERE rn > 1""")
def q_removed(spark, sf):
    kept, removed = dedup.deduplicate(raw(spark, sf), "most_complete", KEYS)
    return dedup.removed_audit(removed, "most_complete", KEYS, AS_OF)


@register("dedup_metrics", S.with_(S.DUPS, _ranked(_COMPLETE)) + """
SELECT 'most_complete' AS strategy, 'o_custkey, o_orderdate' AS business_keys,
       count(*) AS rows_before, count(*) FILTER (WHERE rn = 1) AS rows_after,
       count(*) FILTER (WHERE rn > 1) AS records_removed,
       round(count(*) FILTER (WHERE rn > 1) / greatest(count(*), 1) * 100, 2) AS percentage_removed
FROM ranked""")
def q_metrics(spark, sf):
    d = raw(spark, sf)
    kept, _ = dedup.deduplicate(d, "most_complete", KEYS)
    return dedup.dedup_metrics(d, kept, "most_complete", KEYS)


@register("dedup_report")
def q_report(spark, sf):
    d = raw(spark, sf)
    kept, _ = dedup.deduplicate(d, "most_complete", KEYS)
    return dedup.dedup_report(dedup.dedup_metrics(d, kept, "most_complete", KEYS),
                              dedup.exact_duplicate_stats(d), AS_OF)
