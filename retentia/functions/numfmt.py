"""Number-to-text formatting with Python format-spec semantics.

``F.format_number`` rounds half-even on the exact value like Python's
``format``; ``format_string('%.0f')`` does not, so it is never used for decimals.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col_of


def _no_commas(c: Column) -> Column:
    return F.regexp_replace(c, ",", "")


def fmt_thousands(c) -> Column:
    """``f"{v:,}"`` for integers."""
    return F.format_number(col_of(c).cast("bigint"), 0)


def fmt_fixed(c, digits: int, commas: bool = False) -> Column:
    """``f"{v:.Nf}"`` (``commas=True`` gives ``f"{v:,.Nf}"``)."""
    s = F.format_number(col_of(c).cast("double"), digits)
    return s if commas else _no_commas(s)


def fmt_money(c, digits: int = 2, commas: bool = True) -> Column:
    """``f"${v:,.2f}"`` and friends."""
    return F.concat(F.lit("$"), fmt_fixed(c, digits, commas))


def fmt_percent(c, digits: int = 1) -> Column:
    """``f"{v:.1%}"``: value times 100, fixed digits, no thousands separator."""
    return F.concat(fmt_fixed(col_of(c).cast("double") * 100, digits), F.lit("%"))


def fmt_currency_compact(c) -> Column:
    """Axis label text: $1.2M above a million, $12K above a thousand, else $12."""
    v = col_of(c).cast("double")
    return (F.when(F.abs(v) >= 1_000_000, F.concat(F.lit("$"), fmt_fixed(v / 1_000_000, 1), F.lit("M")))
            .when(F.abs(v) >= 1_000, F.concat(F.lit("$"), fmt_fixed(v / 1_000, 0), F.lit("K")))
            .otherwise(F.concat(F.lit("$"), fmt_fixed(v, 0))))
