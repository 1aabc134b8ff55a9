"""File sources (S1-S8): CSV and JSON scans with the reference's reader semantics.

* CSV: one aggregate over the raw lines (splittable, no whole file in one task)
  finds each file's encoding, its header and whether quoted fields hold line
  breaks.  Files are grouped by these, each group is read by its own paths, and
  the groups are united by name.  Where records span lines, their starts are
  found in parallel: a line turns the state "inside quotes" in one of four ways,
  the lines of a split combine to one such change, and a prefix over the splits
  gives every split its first true record start.
* pandas' missing-value tokens become NULL, and column types are inferred by one
  aggregate over ``try_cast`` checks (the pass that ``inferSchema`` makes).
* JSON: JSON Lines (splittable) or one document (an array, or an object over
  several lines), told apart per file; encodings as for CSV.  Struct columns flatten to ``parent_child`` names.
"""

from __future__ import annotations

import csv
import io
import re
from collections.abc import Sequence
from urllib.parse import unquote

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from ..functions.text import NA_TOKENS, na_to_null
from ..session import materialize

DEFAULT_FALLBACK_ENCODINGS = ("utf-8", "latin1", "cp1252", "iso-8859-1")

# Python codec names -> Java charset names used by Spark's readers.
_JAVA_CHARSET = {"utf-8": "UTF-8", "utf8": "UTF-8", "latin1": "ISO-8859-1", "latin-1": "ISO-8859-1",
                 "iso-8859-1": "ISO-8859-1", "cp1252": "windows-1252", "windows-1252": "windows-1252",
                 "ascii": "US-ASCII"}
# Byte values cp1252 leaves undefined.
_CP1252_UNDEFINED = [0x81, 0x8D, 0x8F, 0x90, 0x9D]


#: Different header lines that one scan accepts (a plan branch each).
MAX_HEADERS = 64


def _file_sizes(spark: SparkSession, path: str) -> DataFrame:
    """(path, length) of every file under ``path``; the content column is never read."""
    try:
        return spark.read.format("binaryFile").load(path).select("path", "length")
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e) or "Path does not exist" in str(e):
            raise FileNotFoundError(f"File not found: {path}") from e
        raise


def check_source(spark: SparkSession, path: str, kind: str = "CSV") -> None:
    """Raise like the reference: missing path -> FileNotFoundError, no bytes -> ValueError."""
    sizes = _file_sizes(spark, path)
    total = sizes.agg(F.coalesce(F.sum("length"), F.lit(0)).alias("n")).first()["n"]
    if total == 0:
        raise ValueError(f"{kind} file is empty: {path}")


def candidate_encodings(encoding: str, fallback: Sequence[str]) -> list[str]:
    """The encodings that a scan checks: aliases of one Java charset once, in order of preference."""
    by_charset: dict[str, str] = {}
    for name in (encoding, *fallback):
        by_charset.setdefault(_JAVA_CHARSET.get(name.lower(), name), name)
    return list(by_charset.values())


def _decodes(enc: str, line: Column) -> Column:
    e = enc.lower()
    if e in ("utf-8", "utf8"):
        return F.is_valid_utf8(line)
    if e in ("latin1", "latin-1", "iso-8859-1"):
        return F.lit(True)  # every byte is a Latin-1 character
    if e == "ascii":
        return ~F.hex(line.cast("binary")).rlike("^(..)*?[89A-F].")
    if e in ("cp1252", "windows-1252"):
        bad = "|".join(f"{b:02X}" for b in _CP1252_UNDEFINED)
        return ~F.hex(line.cast("binary")).rlike(f"^(..)*?({bad})")
    raise ValueError(f"unsupported encoding: {enc}")


def detect_file_encodings(spark: SparkSession, path: str, candidates: Sequence[str]) -> DataFrame:
    """(file_path, encoding): the first candidate that decodes every line of the file, NULL if none."""
    lines = spark.read.format("text").load(path).select(F.col("_metadata.file_path").alias("file_path"), "value")
    per_file = lines.groupBy("file_path").agg(
        *[F.bool_and(_decodes(e, F.col("value"))).alias(f"ok{i}") for i, e in enumerate(candidates)])
    choice = None
    for i, e in enumerate(candidates):
        choice = F.when(F.col(f"ok{i}"), F.lit(e)) if choice is None else choice.when(F.col(f"ok{i}"), F.lit(e))
    return per_file.select("file_path", choice.alias("encoding"))


# The text forms that pandas reads as a number.
_INTEGER = r"^\s*[+-]?\d+\s*$"
_NUMBER = r"(?i)^\s*[+-]?((\d+\.?\d*|\.\d+)(e[+-]?\d+)?|inf|infinity)\s*$"


def _infer_types(df: DataFrame) -> DataFrame:
    """pandas-like type inference over text columns: BIGINT, DOUBLE, BOOLEAN or STRING, in one pass.

    Numbers are recognised by their text, since a cast to DOUBLE also takes suffixes such as ``10d``.
    """
    cols = df.columns
    checks = []
    for c in cols:
        x = F.col(c)
        checks += [F.count(x).alias(f"{c}__n"),
                   F.count(F.when(x.rlike(_INTEGER), F.trim(x).try_cast("bigint"))).alias(f"{c}__i"),
                   F.count_if(x.rlike(_NUMBER)).alias(f"{c}__d"),
                   F.count_if(x.isin("True", "False", "true", "false", "TRUE", "FALSE")).alias(f"{c}__b")]
    stats = df.agg(*checks).first()
    out = []
    for c in cols:
        n, i, d, b = stats[f"{c}__n"], stats[f"{c}__i"], stats[f"{c}__d"], stats[f"{c}__b"]
        if n == 0:
            out.append(F.col(c).cast("double").alias(c))   # all missing -> float64 in pandas
        elif i == n:
            out.append(F.trim(F.col(c)).try_cast("bigint").alias(c))
        elif d == n:
            out.append(F.trim(F.col(c)).try_cast("double").alias(c))
        elif b == n:
            out.append(F.lower(F.col(c)).cast("boolean").alias(c))
        else:
            out.append(F.col(c))
    return df.select(*out)


_EXTRA = "__too_many_fields"


#: What a line does to "inside a quoted field": nothing, ends outside whatever was before, ends inside, or turns it round.
_SAME, _OUTSIDE, _INSIDE, _TURN = 0, 1, 2, 3


def _line_kind(line: Column, delimiter: str, quote: str, comment: str | None) -> Column:
    """How a line changes the state, by the rules of the parser: only a quote that begins a field opens it, two stand for one.

    A walk over the parts between quotes: 0 record start, 1 in a field, 2 inside quotes, 3 after a quote inside.
    """
    parts = F.split(line, "[" + quote + "]" if quote != "^" else r"\^", -1)
    before = F.slice(parts, F.lit(1), F.size(parts) - 1)

    def step(state: Column, s: Column) -> Column:
        begins = s.endswith(delimiter) | s.endswith("\r") | ((state == 0) & (s == ""))
        return F.when(state == 2, 3).when((state == 3) & (s == ""), 2).when(begins, 2).otherwise(1)

    def inside(start: int) -> Column:
        return F.aggregate(before, F.lit(start), step) == 2

    opens = inside(0) & ~F.startswith(line, F.lit(comment)) if comment else inside(0)
    kind = F.when(opens & inside(2), _INSIDE).when(opens, _TURN).when(inside(2), _SAME).otherwise(_OUTSIDE)
    return F.when(F.contains(line, F.lit(quote)), kind).otherwise(_SAME)


def _lines(spark: SparkSession, path, delimiter: str, options: dict) -> DataFrame:
    """(file_path, at, row, value, sep, kind) of every line as raw bytes; files are split, ``at`` is where the split begins.

    Lines end at ``\n``, or at a ``\r`` before more text; ``\r\n`` leaves the ``\r`` in the value.
    """
    raw = spark.read.format("text").option("lineSep", "\n").load(path)
    # Bytes as Latin-1 letters survive the split whatever the file's encoding is.
    letters = F.split(F.decode(F.col("value").cast("binary"), "ISO-8859-1"), "\r", -1)
    bytes_again = F.transform(letters, lambda x: F.encode(x, "ISO-8859-1").cast("string"))
    parts = F.when(F.col("value").rlike("(?s)\r."), bytes_again).otherwise(F.array("value"))
    cut = raw.select(F.col("_metadata.file_path").alias("file_path"), F.col("_metadata.file_block_start").alias("at"),
                     F.size(parts).alias("n"), F.posexplode(parts).alias("i", "value"))
    value = F.when((F.col("at") == 0) & F.startswith("value", F.lit("\ufeff")), F.substring("value", 2, 2**31 - 1)).otherwise(F.col("value"))
    kind = _line_kind(F.col("value"), delimiter, options.get("quote", '"'), options.get("comment"))
    return cut.select("file_path", "at", F.monotonically_increasing_id().alias("row"), value.alias("value"),
                      F.when(F.col("i") < F.col("n") - 1, "\r").otherwise("\n").alias("sep")).withColumn("kind", kind)


def _blank(value: Column) -> Column:
    return F.trim(value, F.lit(" \t\r")) == ""


def _intake(lines: DataFrame, candidates: Sequence[str], comment: str | None) -> DataFrame:
    """One aggregate over the lines: per file and split the encodings that decode it, its first line, and what it does to the state.

    Of the lines that end outside quotes only the last one matters, so a split's list holds the others: lines that open a
    field and do not close it.
    """
    value, kind = F.col("value"), F.col("kind")
    first = ~_blank(value) if not comment else ~_blank(value) & ~F.startswith(value, F.lit(comment))
    per_split = lines.groupBy("file_path", "at").agg(
        *[F.bool_and(_decodes(e, value)).alias(f"ok{i}") for i, e in enumerate(candidates)],
        F.min(F.when(first, F.struct("row", "value", "kind"))).alias("first"),
        F.max(F.when(kind == _OUTSIDE, F.col("row"))).alias("outside"),
        F.collect_list(F.when(kind.isin(_INSIDE, _TURN), F.struct("row", "kind"))).alias("open"))
    last = F.filter(F.array_sort("open"), lambda x: x["row"] > F.coalesce("outside", F.lit(-1)))
    start = F.when(F.col("outside").isNull(), _SAME).otherwise(_OUTSIDE)
    after = F.create_map(*[F.lit(x) for x in (_SAME, _TURN, _TURN, _SAME, _OUTSIDE, _INSIDE, _INSIDE, _OUTSIDE)])
    whole = F.aggregate(last, start, lambda acc, x: F.when(x["kind"] == _INSIDE, _INSIDE).otherwise(after[acc]))
    return per_split.select("file_path", "at", "first", whole.alias("kind"), (F.size("open") > 0).alias("spans"),
                            *[f"ok{i}" for i in range(len(candidates))])


def _file_intake(splits: DataFrame, candidates: Sequence[str]) -> DataFrame:
    """(file_path, encoding, header, spans, complete) per file: whether records span lines, and whether the last quote is closed."""
    choice = None
    for i, e in enumerate(candidates):
        ok = F.bool_and(F.col(f"ok{i}"))
        choice = F.when(ok, F.lit(e)) if choice is None else choice.when(ok, F.lit(e))
    ended = _with_state(splits, W.partitionBy("file_path").orderBy("at"), F.lit(0))
    ends_inside = F.when(F.col("kind") == _SAME, F.col("state")).when(F.col("kind") == _TURN, 1 - F.col("state")).otherwise(
        (F.col("kind") == _INSIDE).cast("int"))
    head = F.min(F.when(F.col("first").isNotNull(), F.struct("at", "first")))
    return ended.withColumn("ends", ends_inside).groupBy("file_path").agg(
        choice.alias("encoding"), head.alias("head"), F.bool_or("spans").alias("spans"), F.max_by("ends", "at").alias("ends")).select(
        "file_path", "encoding", F.col("head.first.value").alias("header"), F.col("head.first.kind").isin(_INSIDE, _TURN).alias("long_header"),
        "spans", (F.col("ends") == 0).alias("complete"))


def _with_state(rows: DataFrame, window, start: Column) -> DataFrame:
    """``state`` before each row (1: inside quotes): the last fixed end before it, turned round once for every later turn."""
    before = window.rowsBetween(W.unboundedPreceding, -1)
    turns = F.coalesce(F.sum((F.col("kind") == _TURN).cast("int")).over(before), F.lit(0))
    fixed = F.when(F.col("kind").isin(_OUTSIDE, _INSIDE), F.struct((F.col("kind") == _INSIDE).cast("int").alias("end"), "turns"))
    out = rows.withColumn("turns", turns).withColumn("fixed", F.last(fixed, ignorenulls=True).over(before))
    state = F.when(F.col("fixed").isNull(), start + F.col("turns")).otherwise(F.col("fixed.end") + F.col("turns") - F.col("fixed.turns"))
    return out.withColumn("state", F.pmod(state, F.lit(2))).drop("turns", "fixed")


def _records(lines: DataFrame, candidates: Sequence[str], comment: str | None) -> DataFrame:
    """(file_path, header, value): the records of files whose quoted fields hold line breaks, in any number of splits.

    Each split's start state follows from the splits before it, each line's from the split's; lines that are a record by
    themselves stay as they are, and only lines of longer records are grouped.
    """
    lines = materialize(lines)  # one reading fixes the splits and rows that the steps below refer to
    by_file = W.partitionBy("file_path").orderBy("at")
    header = F.first("first.row", ignorenulls=True).over(by_file.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    splits = _with_state(_intake(lines, candidates, comment), by_file, F.lit(0)).select(
        "file_path", "at", F.col("state").alias("start"), header.alias("header"))
    inside = W.partitionBy("file_path", "at").orderBy("row")
    marked = _with_state(lines.join(splits, ["file_path", "at"]), inside, F.col("start"))
    if comment:
        marked = marked.where((F.col("state") == 1) | ~F.startswith("value", F.lit(comment)))
    begins = F.when(F.col("state") == 0, F.col("row"))
    marked = materialize(marked.withColumn("owner", F.max(begins).over(inside.rowsBetween(W.unboundedPreceding, 0))).drop("start"))
    opens = F.col("kind").isin(_INSIDE, _TURN)  # comments outside quotes are gone, and they open nothing
    alone = marked.where((F.col("state") == 0) & ~opens).select("file_path", "row", "value", "header")
    parts = marked.where((F.col("state") == 1) | opens)
    # Lines before a split's first record belong to the last record that began in an earlier split.
    owners = marked.groupBy("file_path", "at").agg(F.max("owner").alias("last"))
    carried = owners.withColumn("carried", F.last("last", ignorenulls=True).over(
        W.partitionBy("file_path").orderBy("at").rowsBetween(W.unboundedPreceding, -1))).drop("last")
    heads = parts.where("owner IS NULL").join(carried, ["file_path", "at"]).withColumn("owner", F.col("carried")).drop("carried")
    grouped = parts.where("owner IS NOT NULL").unionByName(heads).groupBy("file_path", "owner").agg(
        F.array_sort(F.collect_list(F.struct("at", "row", "value", "sep"))).alias("parts"), F.max("header").alias("header"))
    joined = F.array_join(F.transform("parts", lambda x: F.concat(x["value"], x["sep"])), "")
    long = grouped.select("file_path", F.col("owner").alias("row"), joined.alias("value"), "header")
    found = alone.unionByName(long).where(~_blank(F.col("value")))
    return found.select("file_path", (F.col("row") == F.col("header")).alias("header"), "value")


def _fields(header: str, delimiter: str) -> list[str]:
    """Column names of a header line; repeated names are numbered as pandas does."""
    seen: dict[str, int] = {}
    out = []
    for name in next(csv.reader(io.StringIO(header.lstrip("\ufeff").rstrip("\r\n"), newline=""), delimiter=delimiter)):
        k = seen.get(name, 0)
        seen[name] = k + 1
        out.append(f"{name}.{k}" if k else name)
    return out


def _csv_schema(names: Sequence[str]) -> StructType:
    return StructType([StructField(f"f{i}", StringType()) for i in range(len(names))] + [StructField(_EXTRA, StringType())])


def _named_fields(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """The parsed fields by name.  A record with more fields than the header fails the scan."""
    # A filter that raises cannot be pruned away with the extra column.
    df = df.where(F.when(F.col(_EXTRA).isNotNull(), F.raise_error(F.concat(
        F.lit(f"a record has more than the {len(names)} fields of its header, next field: "), F.col(_EXTRA)))
        .cast("boolean")).otherwise(F.lit(True)))
    return df.select(*[F.col(f"f{i}").alias(n) for i, n in enumerate(names)])


def _read_csv_group(spark: SparkSession, path, delimiter: str, encoding: str, header: str, multi_line: bool, options: dict) -> DataFrame:
    """Files of one encoding and header whose records Spark's reader finds, every column as text."""
    names = _fields(header, delimiter)
    reader = (spark.read.schema(_csv_schema(names)).option("header", True).option("enforceSchema", True).option("sep", delimiter)
              .option("encoding", _JAVA_CHARSET.get(encoding.lower(), encoding)).option("quote", '"').option("escape", '"')
              .option("multiLine", multi_line).option("mode", "PERMISSIVE").options(**options))
    return _named_fields(reader.csv(path), names)


def _parse_records(records: DataFrame, delimiter: str, encoding: str, header: str, options: dict) -> DataFrame:
    """Records as text -> columns; a file's first record is its header."""
    names = _fields(header, delimiter)
    opts = {"sep": delimiter, "quote": '"', "escape": '"', "multiLine": "true", "lineSep": "\n", "mode": "PERMISSIVE", **options}
    value = F.regexp_replace(_decoded(F.col("value"), encoding), r"(\r\n|\n|\r)\z", "")
    parsed = F.from_csv(value, ", ".join(f"{f.name} string" for f in _csv_schema(names)),
                        {k: str(v) for k, v in opts.items()})
    return _named_fields(records.select(parsed.alias("r")).select("r.*"), names)


def _glob_free(file_path: str) -> str:
    """A file's path as the reader takes it: not URL-encoded, and no sign of it a pattern."""
    return re.sub(r"([\\{}\[\]*?])", r"\\\1", unquote(file_path))


def scan_csv(spark: SparkSession, path: str, delimiter: str = ",", encoding: str = "utf-8",
             fallback_encodings: Sequence[str] = DEFAULT_FALLBACK_ENCODINGS, na_values: Sequence[str] | None = None,
             infer_types: bool = True, parse_dates: Sequence[str] = (), with_encoding: bool = False,
             encoding_column: str | None = None, multi_line: bool | None = None, **options):
    """Header CSV -> DataFrame (and the encoding per file when ``with_encoding``).

    One pass over the lines finds each file's encoding, header (its first line that is not blank) and whether records
    span lines.  Files are grouped by these and united by column name.  Where quoted fields hold line breaks, record
    starts are found in parallel over the splits; other files go to Spark's reader as they are.  A quote that is never
    closed is an error.  ``multi_line`` True lets Spark parse whole files instead, False takes each line as a record.
    ``options`` go to Spark's reader (e.g. ``comment="#"``).
    Returns ``(df, encodings)`` where ``encodings`` is a frame (file_path, encoding).
    ``encoding_column`` adds the encoding each row was decoded with.
    """
    check_source(spark, path, "CSV")
    cands = candidate_encodings(encoding, fallback_encodings)
    comment = options.get("comment")
    files = materialize(_file_intake(_intake(_lines(spark, path, delimiter, options), cands, comment), cands))
    if multi_line is not None:
        files = files.withColumns({"spans": F.lit(False), "complete": F.lit(True)})
    wrong = files.where("encoding IS NULL OR NOT complete").select("file_path", "encoding").first()
    if wrong is not None and wrong["encoding"] is None:
        raise ValueError(f"Failed to decode {path} using encodings {cands}")
    if wrong is not None:
        raise ValueError(f"a quoted field never ends: {wrong['file_path']}")
    found = files.where("header IS NOT NULL")
    if multi_line is not False:  # a header that spans lines is a record like others
        long = [_glob_free(r["file_path"]) for r in found.where("long_header").select("file_path").collect()]
        if long:
            heads = _records(_lines(spark, long, delimiter, options), cands, comment).where("header").select(
                "file_path", F.col("value").alias("whole"))
            found = materialize(found.join(heads, "file_path", "left").withColumn("header", F.coalesce("whole", "header")).drop("whole"))
    found = found.withColumn("header", F.coalesce(*[F.when(F.col("encoding") == e, _decoded(F.col("header"), e)) for e in cands]))
    groups = sorted(found.select("encoding", "header", "spans").distinct().limit(2 * MAX_HEADERS * len(cands) + 1).collect(),
                    key=lambda r: (cands.index(r["encoding"]), r["header"], r["spans"]))
    if len({(r["encoding"], r["header"]) for r in groups}) > MAX_HEADERS * len(cands):
        raise ValueError(f"{path} holds more than {MAX_HEADERS} different headers")
    parts = []
    for e, header, spans in groups:
        # One row per file, as in the listing that any reader of the folder makes.
        only = path if len(groups) == 1 else [_glob_free(r["file_path"]) for r in found.where(
            (F.col("encoding") == e) & (F.col("header") == header) & (F.col("spans") == spans)).select("file_path").collect()]
        if spans:
            records = materialize(_records(_lines(spark, only, delimiter, options), cands, comment).where("NOT header").select("value"))
            part = _parse_records(records, delimiter, e, header, options)
        else:
            part = _read_csv_group(spark, only, delimiter, e, header, bool(multi_line), options)
        parts.append(part.withColumn(encoding_column, F.lit(e)) if encoding_column else part)
    if not parts:
        raise ValueError(f"CSV file is empty: {path}")
    df = parts[0]
    for p in parts[1:]:
        df = df.unionByName(p, allowMissingColumns=True)
    tokens = NA_TOKENS if na_values is None else list(na_values)
    df = df.select(*[na_to_null(F.col(c), tokens).alias(c) if c != encoding_column else F.col(c)
                     for c in df.columns])
    if infer_types:
        keep = [c for c in df.columns if c not in parse_dates and c != encoding_column]
        typed = _infer_types(df.select(*keep)) if keep else None
        df = _apply_types(df, typed, parse_dates)
    return (df, files.select("file_path", "encoding")) if with_encoding else df


def _apply_types(df: DataFrame, typed: DataFrame | None, parse_dates: Sequence[str]) -> DataFrame:
    exprs = []
    for c in df.columns:
        if c in parse_dates:
            exprs.append(F.try_to_timestamp(F.col(c)).cast("timestamp_ntz").alias(c))
        elif typed is None or c not in typed.columns:
            exprs.append(F.col(c))
        else:
            t = typed.schema[c].dataType
            if t.simpleString() == "boolean":
                exprs.append(F.lower(F.col(c)).cast("boolean").alias(c))
            elif t.simpleString() == "string":
                exprs.append(F.col(c))
            else:
                exprs.append(F.col(c).try_cast(t).alias(c))
    return df.select(*exprs)


def flatten_columns(df: DataFrame, sep: str = "_") -> DataFrame:
    """Recursively replace struct columns by ``parent<sep>child`` columns; arrays stay as they are."""
    def walk(dtype, path, name):
        if isinstance(dtype, StructType):
            out = []
            for f in dtype.fields:
                out += walk(f.dataType, path + [f.name], f"{name}{sep}{f.name}" if name else f.name)
            return out
        col = F.col(".".join(f"`{p}`" for p in path))
        return [col.alias(name)]
    exprs = []
    for f in df.schema.fields:
        exprs += walk(f.dataType, [f.name], f.name)
    return df.select(*exprs)


def explode_records(df: DataFrame, record_path: str | Sequence[str], meta: Sequence = (), sep: str = "_",
                    flatten: bool = True) -> DataFrame:
    """``json_normalize(record_path=, meta=)``: one row per element of the nested list, with meta columns.

    A path of several names goes level by level: through an array to each of its elements, through a struct to its
    field.  A meta path of ``n`` names is read from the object of level ``n - 1`` on the way to the records (level 0 is
    the row), a longer one from the object that holds the records.
    An empty or missing list yields no rows (pandas raises on a missing path).
    """
    def column(level: int, names: Sequence[str]) -> Column:
        return F.col(("_rec." if level else "") + ".".join(f"`{n}`" for n in names))

    path = [record_path] if isinstance(record_path, str) else list(record_path)
    metas = [[m] if isinstance(m, str) else list(m) for m in meta]
    out, taken = df, []
    for level, name in enumerate(path):
        here = [i for i, m in enumerate(metas) if min(len(m), len(path)) - 1 == level]
        out = out.select(*[f"_m{i}" for i in taken], *[column(level, metas[i][level:]).alias(f"_m{i}") for i in here],
                         column(level, [name]).alias("_rec"))
        taken += here
        out = out.withColumn("_rec", F.explode("_rec")) if isinstance(out.schema["_rec"].dataType, ArrayType) else out.where("_rec IS NOT NULL")
    elem = out.schema["_rec"].dataType
    fields = [F.col(f"_rec.`{f.name}`").alias(f.name) for f in elem.fields] if isinstance(elem, StructType) else [F.col("_rec").alias("0")]
    out = out.select(*fields, *[F.col(f"_m{i}").alias(sep.join(m)) for i, m in enumerate(metas)])
    return flatten_columns(out, sep) if flatten else out


def _one_value(text: Column) -> Column:
    """Whether a text is exactly one JSON value: between "[" and another element it makes an array of two."""
    found = F.from_json(F.concat(F.lit("["), F.ltrim(text, F.lit("\ufeff \t\r\n")), F.lit(',"end"]')), "array<string>")
    return F.coalesce((F.size(found) == 2) & (F.try_element_at(found, F.lit(2)) == "end"), F.lit(False))


def _documents(spark: SparkSession, path: str) -> DataFrame:
    """(file_path, document): whether a file is one JSON document, i.e. its first line that is not blank is no value by itself."""
    lines = spark.read.format("text").option("lineSep", "\n").load(path).select(
        F.col("_metadata.file_path").alias("file_path"), F.col("_metadata.file_block_start").alias("at"),
        F.monotonically_increasing_id().alias("row"), "value")
    first = lines.where(F.length(F.trim("value", F.lit("\ufeff \t\r"))) > 0).groupBy("file_path").agg(
        F.min_by("value", F.struct("at", "row")).alias("value"))
    return first.select("file_path", (~_one_value(F.col("value"))).alias("document"))


def _decoded(text: Column, encoding: str) -> Column:
    """The characters of a text column that holds a file's bytes."""
    charset = _JAVA_CHARSET.get(encoding.lower(), encoding)
    if charset == "UTF-8":
        return text
    out = F.decode(text.cast("binary"), "US-ASCII" if charset == "US-ASCII" else "ISO-8859-1")
    if charset == "windows-1252":
        codes = bytes(b for b in range(0x80, 0xA0) if b not in _CP1252_UNDEFINED)
        out = F.translate(out, codes.decode("latin1"), codes.decode("cp1252"))
    return out


def _read_json_files(spark: SparkSession, path: str, files: DataFrame, document: bool, encoding: str, reader) -> DataFrame:
    """The records of ``files`` (file_path) only, so that no file of the other kind is parsed or has a part in the schema."""
    texts = spark.read.format("text").option("wholetext", document).option("lineSep", "\n").load(path).select(
        F.col("_metadata.file_path").alias("file_path"), "value").join(files, "file_path", "left_semi")
    texts = texts.select(_decoded(F.col("value"), encoding).alias("value")).where(F.length(F.trim("value", F.lit("\ufeff \t\r\n"))) > 0)
    strings = getattr(texts._jdf, "as")(spark._jvm.org.apache.spark.sql.Encoders.STRING())
    return DataFrame(reader._jreader.json(strings), spark)


def scan_json(spark: SparkSession, path: str, flatten: bool = True, record_path=None, meta: Sequence[str] = (),
              sep: str = "_", multi_line: bool | None = None, schema=None, encoding: str = "utf-8",
              fallback_encodings: Sequence[str] = DEFAULT_FALLBACK_ENCODINGS, with_encoding: bool = False):
    """JSON files -> DataFrame (and the encoding per file when ``with_encoding``).

    By default each file's first line tells a document (array) from JSON Lines, which stay splittable; ``multi_line``
    sets it for all files.  A document file with more than one root value is an error.
    Encodings are tried per file as for CSV.  Invalid JSON fails with Spark's parse error.
    """
    check_source(spark, path, "JSON")
    cands = candidate_encodings(encoding, fallback_encodings)
    enc = materialize(detect_file_encodings(spark, path, cands))
    kinds = _documents(spark, path) if multi_line is None else enc.select("file_path", F.lit(multi_line).alias("document"))
    kinds = materialize(enc.join(kinds, "file_path", "left").withColumn("document", F.coalesce("document", F.lit(False))))
    found = {(r["encoding"], r["document"]) for r in kinds.select("encoding", "document").distinct().collect()}
    if any(e is None for e, _ in found):
        raise ValueError(f"Failed to decode {path} using encodings {cands}")
    if any(document for _, document in found):
        # Spark's reader takes the first root value of a document and says nothing of others.
        whole = spark.read.format("text").option("wholetext", True).load(path).select(
            F.col("_metadata.file_path").alias("file_path"), "value")
        wrong = whole.join(kinds.where("document"), "file_path", "left_semi").where(
            ~_one_value(F.col("value")) & (F.length(F.trim("value", F.lit("\ufeff \t\r\n"))) > 0)).select("file_path").first()
        if wrong is not None:
            raise ValueError(f"not one JSON value, nor one in each line: {wrong['file_path']}")
    parts = []
    for e, document in sorted(found, key=lambda x: (cands.index(x[0]), x[1])):
        reader = spark.read.option("multiLine", document).option("mode", "FAILFAST").option("lineSep", "\n")
        if schema is not None:
            reader = reader.schema(schema)
        if len(found) == 1:
            parts.append(reader.option("encoding", _JAVA_CHARSET.get(e.lower(), e)).json(path))
        else:
            only = kinds.where((F.col("encoding") == e) & (F.col("document") == document)).select("file_path")
            parts.append(_read_json_files(spark, path, only, document, e, reader))
    df = parts[0]
    for p in parts[1:]:
        df = df.unionByName(p, allowMissingColumns=True)
    if record_path is not None:
        df = explode_records(df, record_path, meta, sep, flatten)
    elif flatten:
        df = flatten_columns(df, sep)
    return (df, enc) if with_encoding else df


def scan_kpi_targets(spark: SparkSession, path: str) -> DataFrame:
    """``{kpi: {"min": .., "max": ..}, ...}`` -> long (kpi, min, max)."""
    raw = spark.read.option("multiLine", True).json(path)
    kpis = raw.columns
    return raw.select(F.explode(F.array(*[
        F.struct(F.lit(k).alias("kpi"), F.col(f"`{k}`.min").cast("double").alias("min"),
                 F.col(f"`{k}`.max").cast("double").alias("max")) for k in kpis])).alias("x")).select("x.*")

