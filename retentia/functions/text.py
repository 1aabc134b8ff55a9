"""Text helpers that reproduce Python string semantics with Spark expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# The tokens pandas' CSV reader treats as missing by default.
NA_TOKENS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
             "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]


def col_of(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# The characters Python's str.strip() treats as whitespace.
PY_WHITESPACE = (r"\s\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}"
                 r"\x{202f}\x{205f}\x{3000}")
_STRIP_RE = f"^[{PY_WHITESPACE}]+|[{PY_WHITESPACE}]+$"


def py_strip(c) -> Column:
    """``str.strip()``: remove leading/trailing whitespace as Python defines it (Spark ``trim`` only drops blanks)."""
    return F.regexp_replace(col_of(c), _STRIP_RE, "")


def py_title(c) -> Column:
    """``str.title()``: upper-case the first letter of every run of letters, lower-case the rest.

    ``initcap`` only capitalises after blanks; Python capitalises after any
    non-letter ("O'Neil", "3Rd").  Split into letter / non-letter runs and
    ``initcap`` each run.
    """
    runs = F.regexp_extract_all(col_of(c), F.lit(r"(\p{L}+|[^\p{L}]+)"), 1)
    return F.when(col_of(c).isNull(), None).otherwise(
        F.array_join(F.transform(runs, lambda r: F.initcap(r)), ""))


def na_to_null(c, tokens=None) -> Column:
    """Map CSV missing-value tokens to NULL (after an all-string read)."""
    tokens = NA_TOKENS if tokens is None else list(tokens)
    c = col_of(c)
    return F.when(c.isin(tokens), F.lit(None).cast("string")).otherwise(c)


# Strftime directive -> Spark datetime pattern.  %m and %d map to
# the one-letter forms because strptime accepts unpadded month and day.
_STRFTIME_TO_SPARK = {
    "%Y": "yyyy", "%y": "yy", "%m": "M", "%d": "d", "%H": "H", "%I": "h",
    "%M": "m", "%S": "s", "%f": "SSSSSS", "%p": "a", "%b": "MMM", "%B": "MMMM",
    "%a": "EEE", "%A": "EEEE", "%j": "D", "%z": "Z", "%%": "%",
}


def strftime_to_spark(fmt: str) -> str:
    """Translate a strftime format to a Spark datetime pattern, quoting literal text."""
    out = []
    literal = []

    def flush():
        if literal:
            text = "".join(literal).replace("'", "''")
            out.append(text if re.fullmatch(r"[^A-Za-z]*", text) else f"'{text}'")
            literal.clear()

    i = 0
    while i < len(fmt):
        tok = fmt[i:i + 2]
        if tok in _STRFTIME_TO_SPARK:
            flush()
            out.append(_STRFTIME_TO_SPARK[tok])
            i += 2
        else:
            literal.append(fmt[i])
            i += 1
    flush()
    return "".join(out)


def file_extension(path_col) -> Column:
    """Lower-cased text after the last dot (the whole name when there is no dot)."""
    return F.lower(F.regexp_extract(col_of(path_col), r"([^.]*)$", 1))
