"""Correlation queries (S12, A23-A27, F2, F11) over the ``correlation`` adapter."""

from __future__ import annotations

from ..operators import correlation as co
from ..sources import adapters as ad
from ..sources.loaders import load_correlation_data
from . import sql_adapters as S
from .registry import r6, register

C = S.with_(S.CORR)
FS = co.FEATURES


def data(spark, sf):
    raw = ad.correlation_input(spark, sf)
    return load_correlation_data(raw, ["customer_id"] + FS)


def _pearson_sql(src):
    parts = [f"SELECT '{a}' AS feature_a, '{b}' AS feature_b, round(corr({a}, {b}), 6) AS pearson FROM {src}"
             for a in FS for b in FS]
    return "\nUNION ALL\n".join(parts)


@register("load_correlation_data", C + "SELECT customer_id, engagement, transactions_per_month, support_tickets, churn FROM corr_in")
def q_load(spark, sf):
    return data(spark, sf)


@register("select_features", C + "SELECT customer_id, transactions_per_month, support_tickets, churn FROM corr_in")
def q_select(spark, sf):
    return co.select_features(data(spark, sf))


@register("corr_pearson", C + _pearson_sql("corr_in"))
def q_pearson(spark, sf):
    return co.pearson_matrix(data(spark, sf)).select("feature_a", "feature_b", r6("r").alias("pearson"))


_RANKS = "ranks AS (SELECT " + ", ".join(
    f"rank() OVER (ORDER BY {f}) + (count(*) OVER (PARTITION BY {f}) - 1) / 2.0 AS {f}" for f in FS) + " FROM corr_in)"


def _spearman_sql():
    parts = [f"SELECT '{a}' AS feature_a, '{b}' AS feature_b, round(corr({a}, {b}), 6) AS spearman FROM ranks"
             for a in FS for b in FS]
    return S.with_(S.CORR, _RANKS) + "\nUNION ALL\n".join(parts)


@register("corr_spearman", _spearman_sql())
def q_spearman(spark, sf):
    return co.spearman_matrix(data(spark, sf)).select("feature_a", "feature_b", r6("r").alias("spearman"))


@register("corr_vs_target", S.with_(S.CORR, _RANKS) + " UNION ALL ".join(
    f"SELECT '{f}' AS feature, round((SELECT corr({f}, churn) FROM corr_in), 6) AS pearson, "
    f"round((SELECT corr({f}, churn) FROM ranks), 6) AS spearman" for f in FS))
def q_vs_target(spark, sf):
    c = co.compare_with_target(data(spark, sf))
    return c.select("feature", r6("pearson").alias("pearson"), r6("spearman").alias("spearman"))


@register("corr_strong_pairs", C + f"""
SELECT feature_a, feature_b, pearson FROM (
  SELECT feature_a, feature_b, corr AS pearson FROM (
    SELECT feature_a, feature_b, round(c, 6) AS corr, c FROM (
      {" UNION ALL ".join(f"SELECT '{a}' AS feature_a, '{b}' AS feature_b, corr({a}, {b}) AS c FROM corr_in"
                           for a in FS for b in FS if a < b)}))
  WHERE c IS NOT NULL AND abs(c) > 0.7 AND c <> 1.0 ORDER BY c DESC, feature_a, feature_b LIMIT 10)""")
def q_strong(spark, sf):
    return co.strong_pairs(data(spark, sf)).select("feature_a", "feature_b", r6("r").alias("pearson"))


@register("corr_interpretation", C + f"""
SELECT '{co.INTERPRETATION_PAIR}' AS pair, round(corr(support_tickets, churn), 6) AS correlation,
  '{" | ".join(co.INTERPRETATION_DIRECTIONS)}' AS possible_directions,
  '{co.INTERPRETATION_DATA}' AS data_indicates, '{co.INTERPRETATION_ACTION}' AS action FROM corr_in""")
def q_interp(spark, sf):
    return co.interpretation(data(spark, sf)).withColumn("correlation", r6("correlation"))
