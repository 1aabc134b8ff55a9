"""Exact statistics that stay distributed.

``F.percentile`` / ``F.median`` / ``F.mode`` are exact but keep a map of every
distinct value of a group inside one aggregation buffer, and a global
aggregate merges all of them in one task.  With unbounded distinct values
that task holds the whole column.  The helpers here get the same exact
quantiles by radix selection (counts per bucket, a few rounds, nothing sorted),
ranks from range-partitioned prefix counts (see ``order.py``), and the mode from
a ``groupBy(value)`` that pre-aggregates map-side.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import staging_path
from .order import running_sum


#: Buckets of an open interval in one round of the selection.
CELLS = 65_536
_BINADE = 32  # buckets per power of two in the first round


def _usable(c: str) -> Column:
    v = F.col(c).cast("double")
    return F.when(~F.isnan(v), v)


def _magnitude(v: Column) -> Column:
    """First-round bucket: sign and logarithm, a number that never falls as the value rises."""
    size = F.when(F.abs(v) == float("inf"), F.lit(80_000)).otherwise(
        F.lit(40_000) + F.floor(F.log2(F.abs(v)) * _BINADE))
    return F.when(v == 0, F.lit(0)).when(v > 0, size).otherwise(-size).cast("long")


def _cell(v: Column, low, high) -> Column:
    """Later rounds: ``low`` falls into bucket 0, ``high`` into the last one, so an open interval always splits."""
    low, high = (x if isinstance(x, Column) else F.lit(x) for x in (low, high))
    return F.floor((v - low) / (high - low) * (CELLS - 1))


def _buckets(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Count, least and greatest value of every bucket ``_b`` of a key, with ``_end``, the count up to it.

    The aggregate is partial in every task; a key has a bounded number of buckets, so the window's
    partitions are small whatever the data.
    """
    out = rows.groupBy(*keys, "_b").agg(F.sum("_w").alias("_c"), F.min("_v").alias("_mn"), F.max("_v").alias("_mx"))
    return out.withColumn("_end", F.sum("_c").over(W.partitionBy(*keys).orderBy("_b")))


def _first_picks(buckets: DataFrame, keys: list[str], qs: Sequence[float]) -> DataFrame:
    """Buckets that hold a wanted rank: (keys, qi, pos, rank, off, c, mn, mx), ``off`` the rank inside the bucket."""
    last = F.sum("_c").over(W.partitionBy(*keys)) - 1
    ranks = []
    for i, q in enumerate(qs):
        pos = F.lit(float(q)) * F.col("_last")
        ranks += [F.struct(F.lit(i).alias("qi"), pos.alias("pos"), f(pos).cast("long").alias("rank")) for f in (F.floor, F.ceil)]
    start = F.col("_end") - F.col("_c")
    here = F.filter(F.array_distinct(F.array(*ranks)), lambda t: (t["rank"] >= start) & (t["rank"] < F.col("_end")))
    hits = buckets.withColumn("_last", last).withColumn("_t", F.explode(here))
    return hits.select(*keys, "_t.qi", "_t.pos", "_t.rank", (F.col("_t.rank") - start).alias("off"),
                       F.col("_c").alias("c"), F.col("_mn").alias("mn"), F.col("_mx").alias("mx"))


def _known(off, c, mn, mx):
    """The value at place ``off`` of a bucket if its ends already tell it."""
    return mn if off == 0 or mn == mx else mx if off == c - 1 else None


def _between(low: float, high: float, pos: float) -> float:
    return low if low == high else low + (high - low) * (pos - math.floor(pos))


def column_quantiles(df: DataFrame, columns: Sequence[str], qs: Sequence[float],
                     weight: str | None = None) -> dict[str, list]:
    """Exact linear-interpolated quantiles of several columns, as Python floats (None without values).

    Radix selection: the first round counts all values of all columns by sign and
    logarithm (a few ten thousand buckets per column); the buckets that hold a wanted
    rank become intervals, which the next round splits into ``CELLS`` buckets each.
    Every round is one scan with a partial aggregate, nothing is sorted, shuffled by
    row or stored.  A double is fixed after at most five rounds; most data take two,
    since a bucket's least and greatest value are known.  The driver holds two
    intervals per column and quantile.
    """
    cols = list(dict.fromkeys(columns))
    w = (F.col(weight) if weight else F.lit(1)).cast("long").alias("_w")

    def scan(parts) -> DataFrame:
        rows = df.select(w, F.explode(F.array(*parts)).alias("_x")).select("_w", "_x.*")
        return rows.where(F.col("_b").isNotNull())

    out = {c: [None] * len(qs) for c in cols}
    if not cols:
        return out
    picks = _first_picks(_buckets(scan([
        F.struct(F.lit(i).alias("_k"), _magnitude(_usable(c)).alias("_b"), _usable(c).alias("_v"))
        for i, c in enumerate(cols)]), ["_k"]), ["_k"], qs).collect()
    found: dict[tuple, float] = {}
    wanted = [((r["_k"], r["qi"], r["rank"]), r["off"], r["c"], r["mn"], r["mx"]) for r in picks]
    while True:
        open_: dict[tuple, list] = {}
        for key, off, c, mn, mx in wanted:
            value = _known(off, c, mn, mx)
            if value is None:
                open_.setdefault((key[0], mn, mx), []).append((key, off))
            else:
                found[key] = value
        if not open_:
            break
        spans = list(open_)
        parts = []
        for k in sorted({s[0] for s in spans}):  # the intervals of a column do not overlap
            v, which, cell = _usable(cols[k]), F.lit(None).cast("int"), F.lit(None).cast("long")
            for j, (own, mn, mx) in enumerate(spans):
                if own == k:
                    inside = v.between(mn, mx)
                    which, cell = F.when(inside, F.lit(j)).otherwise(which), F.when(inside, _cell(v, mn, mx)).otherwise(cell)
            parts.append(F.struct(which.alias("_k"), cell.alias("_b"), v.alias("_v")))
        asked = F.array(*[F.struct(F.lit(j).alias("j"), F.lit(off).cast("long").alias("off"))
                          for j, s in enumerate(spans) for off in sorted({o for _, o in open_[s]})])
        start = F.col("_end") - F.col("_c")
        hits = _buckets(scan(parts), ["_k"]).withColumn("_t", F.explode(F.filter(
            asked, lambda t: (t["j"] == F.col("_k")) & (t["off"] >= start) & (t["off"] < F.col("_end")))))
        at = {(r["_k"], r["off"]): r for r in hits.select(
            "_k", "_t.off", (F.col("_t.off") - start).alias("new"), "_c", "_mn", "_mx").collect()}
        wanted = []
        for j, s in enumerate(spans):
            for key, off in open_[s]:
                r = at[j, off]
                wanted.append((key, r["new"], r["_c"], r["_mn"], r["_mx"]))
    for r in picks:
        k, qi, pos = r["_k"], r["qi"], r["pos"]
        out[cols[k]][qi] = _between(found[k, qi, math.floor(pos)], found[k, qi, math.ceil(pos)], pos)
    return out


def _table(df: DataFrame) -> DataFrame:
    """``df`` as a table in the shared checkpoint folder: its size is known to the optimizer, its lineage ends."""
    path = staging_path(df.sparkSession, "selection")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def exact_quantiles(df: DataFrame, value: str, qs: Sequence[float], group: str | None = None,
                    names: Sequence[str] | None = None,
                    weight: str | None = None) -> DataFrame:
    """Linear-interpolated quantiles (pandas / numpy default), exact.

    Returns one row per group (or one row) with a column per quantile, named
    ``names`` (default ``q<q>``).  NULL and NaN values are ignored; groups without
    any value are absent from the result, a whole input without any yields NULLs.
    A NULL group is a group of its own.

    Radix selection as in ``column_quantiles``.  With groups the open intervals are
    a table of one row per group, joined to the values; it is read from files, so
    the optimizer knows its size and broadcasts it only if it is small.  Hot groups
    cost nothing extra: values meet in partial aggregates only.

    ``weight`` names an integer count column when ``df`` already holds
    (value, count) rows, e.g. a value-count table shared with other statistics.
    """
    names = list(names) if names else [f"q{str(q).replace('.', '_')}" for q in qs]
    if group is None:
        found = column_quantiles(df, [value], qs, weight)[value]
        return df.sparkSession.range(1).select(*[F.lit(v).cast("double").alias(n) for n, v in zip(names, found)])
    w = (F.col(weight) if weight else F.lit(1)).cast("long").alias("_w")
    vals = df.select(F.col(group).alias("_g"), _usable(value).alias("_v"), w).where(F.col("_v").isNotNull())
    first = _buckets(vals.withColumn("_b", _magnitude(F.col("_v"))), ["_g"])
    state = _first_picks(first, ["_g"], qs)
    done = None
    ends = F.when((F.col("off") == 0) | (F.col("mn") == F.col("mx")), F.col("mn")).when(F.col("off") == F.col("c") - 1, F.col("mx"))
    while True:
        state = _table(state.withColumn("value", ends))
        part = state.where(F.col("value").isNotNull()).select("_g", "qi", "pos", "rank", "value")
        done = part if done is None else done.unionByName(part)
        open_ = state.where(F.col("value").isNull()).drop("value")
        if open_.isEmpty():
            break
        spans = _table(open_.groupBy(F.col("_g").alias("_h")).agg(
            F.collect_set(F.struct("mn", "mx")).alias("_spans")))  # at most two per quantile
        v = F.col("_v")
        inside = vals.join(spans, F.col("_g").eqNullSafe(F.col("_h"))).select(
            "_g", "_v", "_w", F.explode(F.filter("_spans", lambda s: v.between(s["mn"], s["mx"]))).alias("_s"))
        cells = _buckets(inside.select("_g", F.col("_s.mn").alias("_lo"), "_v", "_w",
                                       _cell(v, F.col("_s.mn"), F.col("_s.mx")).alias("_b")), ["_g", "_lo"])
        old = open_.select(F.col("_g").alias("_h"), F.col("mn").alias("_at"), "qi", "pos", "rank", "off")
        start = F.col("_end") - F.col("_c")
        state = cells.join(old, F.col("_g").eqNullSafe(F.col("_h")) & (F.col("_lo") == F.col("_at"))
                           & (F.col("off") >= start) & (F.col("off") < F.col("_end"))).select(
            "_g", "qi", "pos", "rank", (F.col("off") - start).alias("off"),
            F.col("_c").alias("c"), F.col("_mn").alias("mn"), F.col("_mx").alias("mx"))
    per_q = done.groupBy("_g", "qi", "pos").agg(F.min_by("value", "rank").alias("lo"), F.max_by("value", "rank").alias("hi"))
    share = F.col("pos") - F.floor("pos")
    per_q = per_q.withColumn("qv", F.when(F.col("lo") == F.col("hi"), F.col("lo")).otherwise(
        F.col("lo") + (F.col("hi") - F.col("lo")) * share))
    return per_q.groupBy(F.col("_g").alias(group)).agg(
        *[F.max(F.when(F.col("qi") == i, F.col("qv"))).alias(n) for i, n in enumerate(names)])


def prefix_counts(counts: DataFrame, group: str, value: str, count: str) -> DataFrame:
    """Cumulative count ``_cum`` (inclusive) of each (group, value) row within its group,
    ordered by value, for a table with one row per (group, value).

    Range partitioning plus per-partition prefix sums, with the group's start
    subtracted: no group is ever sorted in one task.
    """
    cum = running_sum(counts, count, "_cum", [F.col(group), F.col(value)])
    start = cum.groupBy(group).agg(F.min(F.col("_cum") - F.col(count)).alias("_start"))
    return cum.join(start, group).withColumn("_cum", F.col("_cum") - F.col("_start")).drop("_start")


def quantile_values(df: DataFrame, value: str, qs: Sequence[float]) -> list:
    """Exact quantiles of one column as Python floats (None when there are no values).

    Used where a quantile feeds later work (thresholds, fill values): the plans
    that follow then carry a literal instead of re-running the selection.
    """
    return column_quantiles(df, [value], qs)[value]


def mode_value(df: DataFrame, value: str, group: str | None = None) -> DataFrame:
    """Most frequent non-null value, smallest value on ties (pandas ``mode().iloc[0]``).

    ``groupBy(value).count()`` pre-aggregates map-side, then ``min_by`` over the
    counts is another partial aggregate: no task ever holds all distinct values.
    """
    gcols = [group] if group else []
    counts = df.filter(F.col(value).isNotNull()).groupBy(*gcols, value).agg(F.count(F.lit(1)).alias("_n"))
    pick = F.min_by(F.col(value), F.struct((-F.col("_n")).alias("n"), F.col(value).alias("v"))).alias("mode")
    if group:
        return counts.groupBy(group).agg(pick)
    return counts.agg(pick)


def pearson(x, y) -> Column:
    """Pearson r that is NULL (pandas NaN) for a constant column instead of failing under ANSI."""
    xc = F.col(x) if isinstance(x, str) else x
    yc = F.col(y) if isinstance(y, str) else y
    return F.try_divide(F.covar_pop(xc, yc), F.stddev_pop(xc) * F.stddev_pop(yc))
