"""Keep filters above expensive columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fence(df: DataFrame, *columns: str) -> DataFrame:
    """Put columns behind a generator of exactly one row.

    The optimizer moves a filter on a computed column below it by repeating the
    computation; through the long chain of detection steps that repeats without
    end.  It does not move a filter below a generator that makes its input.
    Filters on all other columns still reach the scan.
    """
    others = [c for c in df.columns if c not in columns]
    return df.select(*others, F.inline(F.array(F.struct(*columns))))
