"""Revenue distribution (A17-A22, C6-C8): describe, percentiles, shape, value
segments, histograms and a Gaussian density curve.

Every statistic is exact.  Quantiles use the range-partitioned selection of
``functions.stats``; histograms count per bin with a partial aggregate and
join a generated bin spine for the empty bins; the density curve sums kernels
per task with numpy over Spark-partitioned distinct values and adds the
per-task grid vectors.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.stats import exact_quantiles, quantile_values

V = "revenue"
PERCENTILES = [0.25, 0.5, 0.75, 0.9, 0.95, 0.99]
# Interpretation labels.
SHAPE_SKEWED, SHAPE_MODERATE = "Highly right-skewed", "Moderate"
TAILS_FAT, TAILS_NORMAL = "Fat tails (outliers)", "Normal"
ACTION_SPLIT, ACTION_UNIFORM = "Segment into small/enterprise for different strategies", "Uniform strategy"
KDE_POINTS = 1000


def describe(rev: DataFrame) -> DataFrame:
    """count, mean, std (sample), min, 25%, 50%, 75%, max — pandas ``describe``."""
    m = rev.agg(F.count(V).cast("double").alias("count"), F.avg(V).alias("mean"), F.stddev_samp(V).alias("std"),
                F.min(V).alias("min"), F.max(V).alias("max"))
    p25, p50, p75 = quantile_values(rev, V, [0.25, 0.5, 0.75])
    lit = lambda x: F.lit(x).cast("double")
    return m.select("count", "mean", "std", "min", lit(p25).alias("25%"), lit(p50).alias("50%"),
                    lit(p75).alias("75%"), "max")


def percentiles(rev: DataFrame, qs=PERCENTILES) -> DataFrame:
    names = [f"p{i}" for i in range(len(qs))]
    q = exact_quantiles(rev, V, qs, names=names)
    return q.select(F.explode(F.array(*[
        F.struct(F.lit(str(p)).alias("percentile"), F.col(n).alias("value")) for p, n in zip(qs, names)])).alias("x")
    ).select("x.*")


def shape(rev: DataFrame) -> DataFrame:
    """Biased skewness and excess kurtosis (SciPy defaults) = Spark's ``skewness`` / ``kurtosis``."""
    return rev.agg(F.skewness(V).alias("skewness"), F.kurtosis(V).alias("kurtosis"))


def interpretation(rev: DataFrame) -> DataFrame:
    s = shape(rev)
    return s.select(
        F.when(F.col("skewness") > 1, SHAPE_SKEWED).otherwise(SHAPE_MODERATE).alias("shape"),
        F.when(F.col("kurtosis") > 3, TAILS_FAT).otherwise(TAILS_NORMAL).alias("tails"),
        F.when(F.col("skewness") > 1, ACTION_SPLIT).otherwise(ACTION_UNIFORM).alias("business_action"))


def value_segment_rows(rev: DataFrame) -> DataFrame:
    """Rows tagged ``high`` (> q75) / ``low`` (< q25); a side that is empty takes every row.

    The quartiles and the two side counts are one small action each; the rows
    themselves stay distributed.
    """
    q25, q75 = quantile_values(rev, V, [0.25, 0.75])
    if q25 is None:
        return rev.select(V, F.lit(None).cast("string").alias("segment")).limit(0)
    tagged = rev.select(V, F.when(F.col(V) > q75, "high").when(F.col(V) < q25, "low").alias("segment"))
    sides = tagged.agg(F.count_if(F.col("segment") == "high").alias("h"),
                       F.count_if(F.col("segment") == "low").alias("l")).first()
    seg = F.explode(F.array_compact(F.array(
        F.when((F.col("segment") == "high") | F.lit(sides["h"] == 0), F.lit("high")),
        F.when((F.col("segment") == "low") | F.lit(sides["l"] == 0), F.lit("low")))))
    return tagged.select(V, seg.alias("segment"))


def value_segments(rev: DataFrame) -> DataFrame:
    rows = value_segment_rows(rev)
    stats = rows.groupBy("segment").agg(F.count(V).alias("count"), F.avg(V).alias("mean"))
    med = exact_quantiles(rows, V, [0.5], group="segment", names=["median"])
    return stats.join(med, "segment", "inner")


def _bins_spine(stats: DataFrame) -> DataFrame:
    return stats.select("*", F.explode(F.sequence(F.lit(0), F.col("bins") - 1)).alias("bin"))


def histogram(values: DataFrame, value: str = V, group: str | None = None, max_bins: int = 50,
              min_bins: int = 5) -> DataFrame:
    """numpy-style equal-width histogram, bins = min(max_bins, max(min_bins, nunique)).

    Bins are half-open except the last, which is closed; a constant column
    uses the range (v - 0.5, v + 0.5).  Empty bins are present with count 0.
    """
    g = [group] if group else []
    nunique = F.count_distinct(F.col(value))
    stats = values.groupBy(*g).agg(F.min(value).alias("mn"), F.max(value).alias("mx"),
                                   F.least(F.lit(max_bins), F.greatest(F.lit(min_bins), nunique)).cast("int").alias("bins"))
    stats = stats.select(*g, "bins",
                         F.when(F.col("mn") == F.col("mx"), F.col("mn") - 0.5).otherwise(F.col("mn")).alias("lo"),
                         F.when(F.col("mn") == F.col("mx"), F.col("mx") + 0.5).otherwise(F.col("mx")).alias("hi"))
    if g:
        j = values.join(stats, g, "inner")  # one row per group, of any number of groups
    else:
        # One group: the bin parameters are three literals.
        p = stats.first()
        if p is None or p["bins"] is None or p["lo"] is None:
            return values.sparkSession.createDataFrame([], "bin int, bin_start double, bin_end double, count bigint")
        stats = values.sparkSession.createDataFrame([(int(p["bins"]), float(p["lo"]), float(p["hi"]))],
                                                    "bins int, lo double, hi double")
        j = values.select("*", F.lit(int(p["bins"])).alias("bins"), F.lit(float(p["lo"])).alias("lo"),
                          F.lit(float(p["hi"])).alias("hi"))
    idx = F.floor((F.col(value) - F.col("lo")) * (F.col("bins") / (F.col("hi") - F.col("lo")))).cast("int")
    idx = F.least(idx, F.col("bins") - 1)
    counts = j.select(*g, idx.alias("bin")).groupBy(*g, "bin").agg(F.count(F.lit(1)).alias("count"))
    spine = _bins_spine(stats)
    width = (F.col("hi") - F.col("lo")) / F.col("bins")
    out = spine.join(counts, g + ["bin"], "left")
    return out.select(*g, F.col("bin").cast("int").alias("bin"),
                      (F.col("lo") + F.col("bin") * width).alias("bin_start"),
                      F.when(F.col("bin") == F.col("bins") - 1, F.col("hi"))
                      .otherwise(F.col("lo") + (F.col("bin") + 1) * width).alias("bin_end"),
                      F.coalesce("count", F.lit(0)).cast("bigint").alias("count"))


def value_histograms(rev: DataFrame) -> DataFrame:
    """Histograms of the high and low populations, bins = max(1, min(30, nunique))."""
    rows = value_segment_rows(rev)
    return histogram(rows, V, group="segment", max_bins=30, min_bins=1)


def density(rev: DataFrame, points: int = KDE_POINTS) -> DataFrame:
    """Gaussian KDE (Scott bandwidth) on pandas' default grid: ``points`` values over
    [min - range/2, max + range/2].  Columns: point, x, density.

    The four grid parameters are one small aggregate.  Distinct values with
    their counts (a partial aggregate) are scanned by ``mapInPandas``: each task
    adds its values' kernels on the whole grid with numpy and emits one partial
    sum per grid point, and Spark adds the partial sums — ``points`` rows per
    task, however many values there are.
    """
    st = rev.agg(F.count(V).alias("n"), F.stddev_samp(V).alias("sd"), F.min(V).alias("mn"),
                 F.max(V).alias("mx")).first()
    spark = rev.sparkSession
    grid_schema = "point int, x double, density double"
    if not st["n"] or st["sd"] is None or st["sd"] == 0:
        return spark.createDataFrame([], grid_schema)
    n, sd, mn, mx = int(st["n"]), float(st["sd"]), float(st["mn"]), float(st["mx"])
    bw = sd * n ** -0.2
    g0, g1 = mn - 0.5 * (mx - mn), mx + 0.5 * (mx - mn)
    counts = rev.groupBy(V).agg(F.count(F.lit(1)).cast("double").alias("c"))
    partial = counts.mapInPandas(_kde_partial(g0, g1, points, bw), "point int, s double")
    sums = partial.groupBy("point").agg(F.sum("s").alias("s"))
    grid = spark.range(points).select(F.col("id").cast("int").alias("point"))
    dx = (g1 - g0) / (points - 1)
    out = grid.join(sums, "point", "left")
    return out.select("point", (F.lit(g0) + F.col("point") * F.lit(dx)).alias("x"),
                      (F.coalesce("s", F.lit(0.0)) / (n * bw * math.sqrt(2 * math.pi))).alias("density"))


#: exp(-z * z / 2) underflows to 0.0 from here on.
REACH = 39.0


def _kde_partial(g0: float, g1: float, points: int, bw: float, chunk: int = 512):
    """Per-task kernel sums on the grid (numpy; sorted chunks touch only the grid points they reach)."""
    def run(batches):
        import numpy as np
        import pandas as pd
        grid = g0 + np.arange(points) * ((g1 - g0) / (points - 1))
        acc = np.zeros(points)
        seen = False
        for pdf in batches:
            pdf = pdf.sort_values(V)
            v = pdf[V].to_numpy(dtype="float64")
            c = pdf["c"].to_numpy(dtype="float64")
            for i in range(0, len(v), chunk):
                part, weight = v[i:i + chunk], c[i:i + chunk]
                # Beyond REACH bandwidths a kernel is exactly 0.0 in double precision.
                lo, hi = np.searchsorted(grid, [part[0] - REACH * bw, part[-1] + REACH * bw])
                z = (grid[None, lo:hi] - part[:, None]) / bw
                acc[lo:hi] += (weight[:, None] * np.exp(-0.5 * z * z)).sum(axis=0)
                seen = True
        if seen:
            yield pd.DataFrame({"point": np.arange(points, dtype="int32"), "s": acc})
    return run
