"""How catalog entries are registered, and how their columns are shown alike by different engines."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a plan under a name, and the SQL that must give the same rows."""

    def keep(plan):
        if name in QUERIES:
            raise ValueError(f"registered twice: {name}")
        QUERIES[name] = plan
        if sql:
            ORACLES[name] = sql
        return plan

    return keep


def shown(df: DataFrame, columns: str) -> DataFrame:
    """The named columns: `x:t` a time as epoch seconds, `x:l` a long, `x:6` rounded to six digits."""
    out = []
    for c in columns.split():
        name, _, how = c.partition(":")
        col = F.col(name)
        out.append((F.unix_seconds(col) if how == "t" else col.cast("long") if how == "l" else F.round(col, int(how)) if how else col).alias(name))
    return df.select(out)
