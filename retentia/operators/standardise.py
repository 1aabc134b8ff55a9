"""Type standardisation (T1-T8): text -> typed columns, with conversion audits.

Each standardiser is a pure column expression, so a whole schema spec
compiles to ONE ``select`` and its audit to ONE ``agg`` (the reference walks
the frame once per column and per audit).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.text import col_of, py_strip, py_title, strftime_to_spark
from ..session import staging_path

# Literal tokens the standardisers turn into NULL after stripping.
NULL_TEXT = ["nan", "None", ""]
NUMERIC_NULL_TEXT = ["", "nan", "None"]
STRING_NULL_TEXT = ["nan", "None"]
# Default boolean vocabularies (compared after strip + lower).
TRUE_VALUES = ["1", "true", "t", "yes", "y"]
FALSE_VALUES = ["0", "false", "f", "no", "n"]
# Currency symbols removed before numeric parsing.
CURRENCY_LETTERS_PATTERN = "[$,€£₹a-zA-Z]"


def _text(c) -> Column:
    return col_of(c).cast("string")


def standardise_datetime(c, date_format: str = "%Y-%m-%d", errors: str = "coerce") -> Column:
    """Strict parse with a strftime format; unparseable text -> NULL (or an error with ``errors='raise'``)."""
    s = py_strip(_text(c))
    s = F.when(s.isin(NULL_TEXT), None).otherwise(s)
    pattern = strftime_to_spark(date_format)
    parsed = F.try_to_timestamp(s, F.lit(pattern)).cast("timestamp_ntz")
    if errors == "raise":
        parsed = F.when(s.isNotNull() & parsed.isNull(),
                        F.raise_error(F.concat(F.lit("unparseable datetime: "), s)).cast("timestamp_ntz")
                        ).otherwise(parsed)
    return parsed


def clean_numeric_text(c) -> Column:
    """strip -> delete currency symbols -> delete commas -> delete ASCII letters -> strip.

    Deleting characters commutes with the first strip (the final strip removes
    any whitespace the deletions expose), so one combined deletion and one
    strip give the same text with two regex passes instead of five.
    """
    s = py_strip(F.regexp_replace(_text(c), CURRENCY_LETTERS_PATTERN, ""))
    return F.when(s.isin(NUMERIC_NULL_TEXT), None).otherwise(s)


def standardise_numeric(c, target_type: str = "float", errors: str = "coerce") -> Column:
    """Delete currency symbols, commas and every ASCII letter, then parse.

    ``int`` gives a nullable BIGINT (truncating like ``astype(int)``); pandas
    falls back to float when a value is missing, Spark keeps the NULL.
    """
    s = clean_numeric_text(c)
    v = s.try_cast("double")
    if errors == "raise":
        v = F.when(s.isNotNull() & v.isNull(),
                   F.raise_error(F.concat(F.lit("unparseable number: "), s)).cast("double")).otherwise(v)
    if target_type == "int":  # whole numbers exactly; text with a fraction through DOUBLE, truncated
        return F.coalesce(s.try_cast("bigint"), v.try_cast("bigint"))
    return v


def standardise_boolean(c, true_values: Sequence = TRUE_VALUES, false_values: Sequence = FALSE_VALUES,
                        errors: str = "coerce") -> Column:
    t = sorted({str(v).strip().lower() for v in true_values})
    f = sorted({str(v).strip().lower() for v in false_values})
    s = F.lower(py_strip(_text(c)))
    out = F.when(s.isin(t), F.lit(True)).when(s.isin(f), F.lit(False))
    if errors == "raise":
        out = F.when(s.isNotNull() & out.isNull(),
                     F.raise_error(F.concat(F.lit("neither a true nor a false value: "), s)).cast("boolean")
                     ).otherwise(out)
    return out.cast("boolean")


def standardise_string(c, case: str = "preserve", strip_whitespace: bool = True) -> Column:
    s = _text(c)
    if strip_whitespace:
        s = py_strip(s)
        s = F.when(s.isin(STRING_NULL_TEXT), None).otherwise(s)
    if case == "title":
        s = py_title(s)
    elif case == "lower":
        s = F.lower(s)
    elif case == "upper":
        s = F.upper(s)
    return s


def compile_rule(column: str, rules: Mapping) -> tuple[Column | None, str]:
    """One spec entry -> (expression, target label).  Unknown targets -> (None, target)."""
    target = str(rules.get("type", "string")).lower()
    if target == "datetime":
        return standardise_datetime(column, rules.get("format", "%Y-%m-%d")), "datetime"
    if target in ("numeric", "float", "int", "currency"):
        return standardise_numeric(column, "int" if target == "int" else "float"), \
            "int" if target == "int" else "float"
    if target in ("bool", "boolean"):
        return standardise_boolean(column), "boolean"
    if target == "string":
        return standardise_string(column, rules.get("case", "preserve")), "string"
    return None, target


def enforce_dataset_schema(df: DataFrame, spec: Mapping[str, Mapping]) -> DataFrame:
    """Apply a spec in one ``select``.  Columns not in the frame are skipped silently;
    unknown target types leave the column as it is."""
    exprs = []
    for name in df.columns:
        if name in spec:
            e, _ = compile_rule(name, spec[name])
            exprs.append((e if e is not None else F.col(name)).alias(name))
        else:
            exprs.append(F.col(name))
    return df.select(*exprs)


def _audit_plan(raw: DataFrame, spec: Mapping[str, Mapping]) -> list[tuple]:
    """(column, conversion, target, status, initial dtype, final dtype, currency flag) of each spec column present."""
    plan = []
    for c in [c for c in spec if c in raw.columns]:
        e, target = compile_rule(c, spec[c])
        conv = e if e is not None else F.col(c)
        final = raw.select(conv.alias("x")).schema["x"].dataType.simpleString()
        is_cur = str(spec[c].get("type", "")).lower() == "currency" or bool(spec[c].get("is_currency", False))
        plan.append((c, conv, target, "skipped" if e is None else "converted",
                     raw.schema[c].dataType.simpleString(), final, is_cur))
    return plan


def _audit_rows(wide: DataFrame, plan: list[tuple]) -> DataFrame:
    """The audit table from one row of counts: ``in<i>`` inputs and ``ok<i>`` conversions of the i-th entry of ``plan``."""
    rows = wide.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.lit(t).alias("target_type"), F.lit(st).alias("status"),
                 F.lit(first).alias("initial_dtype"), F.lit(final).alias("final_dtype"),
                 F.lit(cur).alias("is_currency"),
                 F.col(f"in{i}").alias("total_inputs"), F.col(f"ok{i}").alias("successful_conversions"))
        for i, (c, _, t, st, first, final, cur) in enumerate(plan)])).alias("r")).select("r.*")
    return rows.select(
        "*", (F.col("total_inputs") - F.col("successful_conversions")).alias("failed_conversions"),
        F.round(F.col("successful_conversions") / F.greatest(F.col("total_inputs"), F.lit(1)) * 100, 2)
        .alias("success_rate_pct"))


def conversion_audit(raw: DataFrame, spec: Mapping[str, Mapping]) -> DataFrame:
    """One row per spec column present: inputs, successes, failures and rate, from ONE aggregate.

    Columns: column, target_type, status, initial_dtype, final_dtype, is_currency,
    total_inputs, successful_conversions, failed_conversions, success_rate_pct.
    """
    plan = _audit_plan(raw, spec)
    if not plan:
        return raw.sparkSession.createDataFrame([], _AUDIT_SCHEMA)
    return _audit_rows(raw.agg(*[agg for i, (c, conv, *_) in enumerate(plan) for agg in
                                 (F.count(F.col(c)).alias(f"in{i}"), F.count(conv).alias(f"ok{i}"))]), plan)


def standardise_dataset(raw: DataFrame, spec: Mapping[str, Mapping], path: str | None = None) -> tuple[DataFrame, DataFrame]:
    """``(table, audit)`` from ONE pass: the typed table is written, and the audit's counts are observed on that write.

    The table is Parquet at ``path`` (overwritten), by default a folder of its own below the shared checkpoint
    folder.  The counts are taken in the stage that writes, of which Spark counts every partition once, so a task
    that is tried again after a lost executor changes nothing.  ``raw`` must not be read from ``path``.
    """
    spark = raw.sparkSession
    plan = _audit_plan(raw, spec)
    conversions = {c: conv for c, conv, *_ in plan}
    numbered = {c: i for i, c in enumerate(conversions)}
    # Positions instead of names: a column of the table may be called like a helper.
    typed = raw.select(*[conversions.get(c, F.col(c)).alias(f"c{k}") for k, c in enumerate(raw.columns)],
                       *[F.col(c).isNotNull().alias(f"given{i}") for c, i in numbered.items()])
    seen = Observation()
    if plan:
        place = {c: k for k, c in enumerate(raw.columns)}
        typed = typed.observe(seen, *[agg for c, i in numbered.items() for agg in
                                      (F.count_if(F.col(f"given{i}")).alias(f"in{i}"),
                                       F.count(F.col(f"c{place[c]}")).alias(f"ok{i}"))])
    table = typed.select(*[F.col(f"c{k}").alias(c) for k, c in enumerate(raw.columns)])
    path = path or staging_path(spark, "standardised")
    table.write.mode("overwrite").parquet(path)
    written = spark.read.schema(table.schema).parquet(path)
    if not plan:
        return written, spark.createDataFrame([], _AUDIT_SCHEMA)
    counts = seen.get
    names = [f"{kind}{i}" for i in range(len(plan)) for kind in ("in", "ok")]
    wide = spark.createDataFrame([tuple(int(counts.get(n) or 0) for n in names)], ", ".join(f"{n} bigint" for n in names))
    return written, _audit_rows(wide, plan)


_AUDIT_SCHEMA = ("column string, target_type string, status string, initial_dtype string, final_dtype string, "
                 "is_currency boolean, total_inputs bigint, successful_conversions bigint, "
                 "failed_conversions bigint, success_rate_pct double")


def sample_failures(raw: DataFrame, spec: Mapping[str, Mapping], order_col: str, k: int = 5) -> DataFrame:
    """The first ``k`` failing raw values per column in row order: (column, sample_rank, row_index, raw_value).

    ``row_number() <= k`` is planned as a per-partition group limit before the
    shuffle, so a column with millions of failures still ships at most k rows
    per input partition.
    """
    failed = []
    for c in [c for c in spec if c in raw.columns]:
        e, _ = compile_rule(c, spec[c])
        if e is not None:
            failed.append(F.when(F.col(c).isNotNull() & e.isNull(), F.struct(
                F.lit(c).alias("column"), F.col(c).cast("string").alias("raw_value"))))
    if not failed:
        return raw.sparkSession.createDataFrame(
            [], "column string, sample_rank int, row_index bigint, raw_value string")
    # One pass over the input: an array of the row's failures, exploded.
    u = raw.select(F.col(order_col).alias("row_index"), F.explode(F.array_compact(F.array(*failed))).alias("f"))
    u = u.select("row_index", "f.column", "f.raw_value")
    w = W.partitionBy("column").orderBy("row_index")
    return (u.withColumn("sample_rank", F.row_number().over(w)).filter(F.col("sample_rank") <= k)
            .select("column", "sample_rank", "row_index", "raw_value"))
