"""Words of letters, and the fold that keeps rows out of training."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_OTHER = re.compile(r"[\W\d_]+")

#: Rows with this remainder of crc32(doc_id as text) modulo ``FOLDS`` are never learnt from.
FOLDS, HELD_OUT = 5, 0


def words(text: str | None) -> list[str]:
    """Lower-case runs of letters."""
    return _OTHER.sub(" ", text.lower()).split() if text else []


def held_out(doc_id: Column) -> Column:
    """Whether a row is held out; a row without doc_id counts as held out."""
    return F.coalesce(F.pmod(F.crc32(F.encode(doc_id.cast("string"), "utf-8")), F.lit(FOLDS)) == HELD_OUT, F.lit(True))


def chance(*columns: str) -> Column:
    """A fixed pseudo-random number below 2**31 of each row, by a hash of ``columns``."""
    return F.pmod(F.xxhash64(*columns), F.lit(2**31))


def cut(rows: int, wanted: int) -> int:
    """About ``wanted`` of ``rows`` rows have a chance below this."""
    return 2**31 if rows <= wanted else int(wanted / rows * 2**31)


def share(rows: int, wanted: int, *columns: str) -> Column:
    """A fixed pseudo-random choice of about ``wanted`` of ``rows`` rows, by a hash of ``columns``."""
    return chance(*columns) < cut(rows, wanted)
