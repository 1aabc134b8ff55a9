"""Query registry: name -> (callable(spark, sf_dir) -> DataFrame, oracle SQL or None)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

REGISTRY: dict[str, tuple[Callable, str | None]] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        if name in REGISTRY:
            raise ValueError(f"query registered twice: {name}")
        REGISTRY[name] = (fn, sql)
        return fn
    return deco


def r6(c) -> Column:
    """Round a double to 6 dp so sums added in a different order compare equal."""
    return F.round((F.col(c) if isinstance(c, str) else c).cast("double"), 6)


def load_all():
    # Importing the modules fills REGISTRY.
    from . import (q_kpi, q_standardise, q_missing, q_dedup, q_profile,  # noqa: F401
                   q_segments, q_distribution, q_timeseries, q_correlation, q_charts, q_files)
    return REGISTRY
