"""Sinks (X1-X7): CSV, JSON and text writers and the report bundles built on them.

Writers are plain ``DataFrameWriter`` calls: distributed, one file per task,
``overwrite`` by default.  Reports are one-row (or few-row) frames, so their
JSON is written as one part.  A bundle is committed whole (``bundle.commit``):
if a member fails, the files of the previous run stay as they were.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType

from .bundle import commit


def write_csv(df: DataFrame, path: str, mode: str = "overwrite", header: bool = True, sep: str = ",", **options) -> str:
    (df.write.mode(mode).option("header", header).option("sep", sep).option("quote", '"').option("escape", '"')
     .option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss").option("dateFormat", "yyyy-MM-dd").options(**options).csv(path))
    return path


def write_json(df: DataFrame, path: str, mode: str = "overwrite", single_file: bool = False) -> str:
    out = df.coalesce(1) if single_file else df
    out.write.mode(mode).option("ignoreNullFields", False).json(path)
    return path


def write_text(df: DataFrame, path: str, column: str = "line", order_by: str | None = None,
               mode: str = "overwrite") -> str:
    """Lines of ``column``; ``order_by`` fixes the line order (one sorted part)."""
    out = df.orderBy(order_by).coalesce(1) if order_by else df
    out.select(F.col(column).cast("string")).write.mode(mode).text(path)
    return path


def round_doubles(df: DataFrame, digits: int) -> DataFrame:
    return df.select(*[F.round(F.col(f.name), digits).alias(f.name) if isinstance(f.dataType, (DoubleType, FloatType))
                       else F.col(f.name) for f in df.schema.fields])


def _csv(df: DataFrame, file: str) -> tuple:
    return file, lambda path: write_csv(df, path)


def _json(df: DataFrame, file: str, single_file: bool = True) -> tuple:
    return file, lambda path: write_json(df, path, single_file=single_file)


def write_segment_report(metrics: DataFrame, worst_first: DataFrame, pivot: DataFrame, insights: DataFrame,
                         out_dir: str) -> dict:
    """X3: insights CSV + metrics / worst-first rounded to 4 dp and the pivot to 2 dp as JSON."""
    return commit(metrics.sparkSession, out_dir, {
        "insights_csv": _csv(insights, "segment_insights.csv"),
        "segment_metrics": _json(round_doubles(metrics, 4), "segment_metrics.json"),
        "worst_first": _json(round_doubles(worst_first, 4), "worst_first.json"),
        "product_revenue_pivot": _json(round_doubles(pivot, 2), "product_revenue_pivot.json")})


def write_strategy_report(summary: DataFrame, performers: DataFrame, narrative: DataFrame, out_dir: str) -> dict:
    """X4: summary CSV, performer JSON and the narrative text file."""
    return commit(summary.sparkSession, out_dir, {
        "summary_csv": _csv(summary, "segment_summary_metrics.csv"),
        "performers": _json(performers, "segment_performer_insights.json"),
        "narrative": ("segment_strategy_summary.txt", lambda path: write_text(narrative, path, "line", "line_no"))})


def write_correlation_report(pearson: DataFrame, spearman: DataFrame, strong: DataFrame, out_dir: str) -> dict:
    """X5: matrices rounded to 4 dp and the strong pairs as JSON."""
    return commit(pearson.sparkSession, out_dir, {
        "pearson": _json(round_doubles(pearson, 4), "pearson.json"),
        "spearman": _json(round_doubles(spearman, 4), "spearman.json"),
        "strong_pairs": _json(strong, "strong_pairs.json")})


def write_kpi_run(kpis: DataFrame, validation: DataFrame, decomposition: DataFrame, out_dir: str) -> dict:
    """The three files of a KPI run: target check, current values, revenue breakdown (largest member first)."""
    return commit(kpis.sparkSession, out_dir, {
        "validation": _csv(validation, "kpi_validation_report.csv"),
        "values": _json(kpis, "kpi_current_values.json"),
        "decomposition": _json(decomposition.orderBy("breakdown", "rank"), "kpi_decomposition.json")})


def write_time_series_report(weekly: DataFrame, monthly: DataFrame, changes: DataFrame, highest: DataFrame, trend: DataFrame,
                             out_dir: str) -> dict:
    """Weekly and monthly tables (2 dp), growth and decline months, highest month, and trend."""
    return commit(weekly.sparkSession, out_dir, {
        "weekly": _json(round_doubles(weekly, 2), "weekly.json", single_file=False),
        "monthly": _json(round_doubles(monthly, 2), "monthly.json", single_file=False),
        "changes": _json(changes, "growth_and_decline_months.json", single_file=False),
        "highest_month": _json(highest, "highest_revenue_month.json"),
        "trend": _json(trend, "trend.json")})


def write_distribution_report(describe: DataFrame, percentiles: DataFrame, shape: DataFrame, segments: DataFrame,
                              interpretation: DataFrame, out_dir: str) -> dict:
    """The parts of the revenue distribution summary, one small JSON file each."""
    parts = {"describe": describe, "percentiles": percentiles, "shape": shape, "value_segments": segments,
             "interpretation": interpretation}
    return commit(describe.sparkSession, out_dir, {name: _json(df, f"revenue_{name}.json") for name, df in parts.items()})


def write_imputation_outputs(cleaned: DataFrame, log: DataFrame, report: DataFrame, out_dir: str) -> dict:
    """The treated table, the treatment log and the before / after report."""
    return commit(cleaned.sparkSession, out_dir, {
        "cleaned": _csv(cleaned, "cleaned_imputed.csv"),
        "log": _json(log.orderBy("step"), "missing_value_treatments.json"),
        "report": _json(report, "missing_value_report.json")})


def write_dedup_outputs(kept: DataFrame, removed: DataFrame, report: DataFrame, out_dir: str) -> dict:
    """The deduplicated table, the audit of removed rows and the report."""
    return commit(kept.sparkSession, out_dir, {
        "kept": _csv(kept, "deduplicated.csv"),
        "removed": _csv(removed, "removed_rows.csv"),
        "report": _json(report, "deduplication_report.json")})
