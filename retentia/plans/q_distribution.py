"""Revenue distribution queries (S14, A17-A22, C6-C8) over the ``sample`` adapter."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import distribution as ds
from ..sources import adapters as ad
from ..sources.loaders import load_revenue
from . import sql_adapters as S
from .registry import r6, register

R = S.with_(S.SAMPLE, "rev AS (SELECT CAST(transaction_amount AS DOUBLE) AS revenue FROM sample "
                      "WHERE transaction_amount IS NOT NULL AND transaction_amount >= 0)")


def rev(spark, sf):
    return load_revenue(ad.sample_transactions(spark, sf))


@register("load_revenue", R + "SELECT revenue FROM rev")
def q_load(spark, sf):
    return rev(spark, sf)


@register("dist_describe", R + """
SELECT CAST(count(revenue) AS DOUBLE) AS count, round(avg(revenue), 6) AS mean, round(stddev_samp(revenue), 6) AS std,
  min(revenue) AS min, round(quantile_cont(revenue, 0.25), 6) AS "25%", round(quantile_cont(revenue, 0.5), 6) AS "50%",
  round(quantile_cont(revenue, 0.75), 6) AS "75%", max(revenue) AS max FROM rev""")
def q_describe(spark, sf):
    d = ds.describe(rev(spark, sf))
    return d.select("count", r6("mean").alias("mean"), r6("std").alias("std"), "min", r6("25%").alias("25%"),
                    r6("50%").alias("50%"), r6("75%").alias("75%"), "max")


@register("dist_percentiles", R + " UNION ALL ".join(
    f"SELECT '{q}' AS percentile, round(quantile_cont(revenue, {q}), 6) AS value FROM rev"
    for q in [0.25, 0.5, 0.75, 0.9, 0.95, 0.99]))
def q_percentiles(spark, sf):
    return ds.percentiles(rev(spark, sf)).withColumn("value", r6("value"))


@register("dist_shape", R + """
SELECT round(skewness(revenue) * (count(revenue) - 2) / sqrt(count(revenue) * (count(revenue) - 1)), 6) AS skewness,
       round(kurtosis_pop(revenue), 6) AS kurtosis FROM rev""")
def q_shape(spark, sf):
    return ds.shape(rev(spark, sf)).select(r6("skewness").alias("skewness"), r6("kurtosis").alias("kurtosis"))


@register("dist_interpretation", R + """
SELECT CASE WHEN sk > 1 THEN 'Highly right-skewed' ELSE 'Moderate' END AS shape,
       CASE WHEN ku > 3 THEN 'Fat tails (outliers)' ELSE 'Normal' END AS tails,
       CASE WHEN sk > 1 THEN 'Segment into small/enterprise for different strategies' ELSE 'Uniform strategy' END AS business_action
FROM (SELECT skewness(revenue) * (count(revenue) - 2) / sqrt(count(revenue) * (count(revenue) - 1)) AS sk,
             kurtosis_pop(revenue) AS ku FROM rev)""")
def q_interp(spark, sf):
    return ds.interpretation(rev(spark, sf))


_SEGROWS = """q AS (SELECT quantile_cont(revenue, 0.25) AS q25, quantile_cont(revenue, 0.75) AS q75 FROM rev),
segrows AS (
  SELECT revenue, 'high' AS segment FROM rev, q WHERE revenue > q75
     OR NOT EXISTS (SELECT 1 FROM rev, q WHERE revenue > q75)
  UNION ALL
  SELECT revenue, 'low' FROM rev, q WHERE revenue < q25
     OR NOT EXISTS (SELECT 1 FROM rev, q WHERE revenue < q25))"""


@register("dist_value_segments", R + ", " + _SEGROWS + """
SELECT segment, count(revenue) AS count, round(avg(revenue), 6) AS mean, round(median(revenue), 6) AS median
FROM segrows GROUP BY segment""")
def q_segments(spark, sf):
    v = ds.value_segments(rev(spark, sf))
    return v.select("segment", "count", r6("mean").alias("mean"), r6("median").alias("median"))


def _hist_sql(src, value, group, max_bins, min_bins):
    gsel = f"{group}, " if group else ""
    gby = f"GROUP BY {group}" if group else ""
    gjoin = f"USING ({group})" if group else "ON true"
    return f"""st AS (SELECT {gsel}CAST(least({max_bins}, greatest({min_bins}, count(DISTINCT {value}))) AS INTEGER) AS bins,
      CASE WHEN min({value}) = max({value}) THEN min({value}) - 0.5 ELSE min({value}) END AS lo,
      CASE WHEN min({value}) = max({value}) THEN max({value}) + 0.5 ELSE max({value}) END AS hi FROM {src} {gby}),
cnt AS (SELECT {gsel}CAST(least(floor(({value} - lo) * (bins / (hi - lo))), bins - 1) AS INTEGER) AS bin, count(*) AS c
        FROM {src} JOIN st {gjoin} GROUP BY ALL),
spine AS (SELECT {gsel}bins, lo, hi, CAST(unnest(range(0, bins)) AS INTEGER) AS bin FROM st)
SELECT {gsel}spine.bin, round(lo + spine.bin * ((hi - lo) / bins), 6) AS bin_start,
       round(CASE WHEN spine.bin = bins - 1 THEN hi ELSE lo + (spine.bin + 1) * ((hi - lo) / bins) END, 6) AS bin_end,
       CAST(coalesce(c, 0) AS BIGINT) AS count
FROM spine LEFT JOIN cnt USING ({gsel}bin)"""


def _hist_out(df, group=None):
    g = [group] if group else []
    return df.select(*g, "bin", r6("bin_start").alias("bin_start"), r6("bin_end").alias("bin_end"), "count")


@register("dist_histogram", R + ", " + _hist_sql("rev", "revenue", None, 50, 5))
def q_hist(spark, sf):
    return _hist_out(ds.histogram(rev(spark, sf)))


@register("dist_value_histograms", R + ", " + _SEGROWS + ", " + _hist_sql("segrows", "revenue", "segment", 30, 1))
def q_vhist(spark, sf):
    return _hist_out(ds.value_histograms(rev(spark, sf)), "segment")


@register("dist_density", R + """, st AS (
  SELECT count(revenue) AS n, stddev_samp(revenue) * pow(count(revenue), -0.2) AS bw,
         min(revenue) - 0.5 * (max(revenue) - min(revenue)) AS g0,
         (max(revenue) + 0.5 * (max(revenue) - min(revenue)) - (min(revenue) - 0.5 * (max(revenue) - min(revenue)))) / 999 AS dx
  FROM rev),
vals AS (SELECT revenue, count(*) AS c FROM rev GROUP BY revenue),
grid AS (SELECT CAST(range AS INTEGER) AS point FROM range(1000))
SELECT point, round(g0 + point * dx, 6) AS x,
       round(sum(c * exp(-0.5 * ((g0 + point * dx - revenue) / bw) * ((g0 + point * dx - revenue) / bw))) / (n * bw * sqrt(2 * pi())), 12) AS density
FROM grid, st, vals GROUP BY point, g0, dx, n, bw""")
def q_density(spark, sf):
    d = ds.density(rev(spark, sf))
    return d.select(F.col("point").cast("int").alias("point"), r6("x").alias("x"), F.round("density", 12).alias("density"))
