"""Ordered operators that survive a key holding a large share of all rows.

A plain window sorts all rows of a key in one task.  These cut the rows of a key
into blocks of consecutive order values, work inside each block, and carry one
summary row per block across the blocks of the key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 100_000


def _blocks(df: DataFrame, order: str, block: int) -> DataFrame:
    return df.withColumn("__block", F.expr(f"cast({order} as bigint) div {block}"))


def _carried(summary: DataFrame, keys: list[str], value: Column, out: str) -> DataFrame:
    """Combine the summaries of all earlier blocks of the key."""
    return summary.select(*keys, "__block", value.alias(out))


def previous_row(
    df: DataFrame, keys: list[str], order: str, columns: list[str], out: str = "prev",
    block: int = BLOCK,
) -> DataFrame:
    """Add a struct of the given columns taken from the previous row of the key."""
    work = _blocks(df, order, block)
    inside = Window.partitionBy(*keys, "__block").orderBy(order)
    across = Window.partitionBy(*keys).orderBy("__block")
    last = work.groupBy(*keys, "__block").agg(
        F.max_by(F.struct(*columns), F.col(order)).alias("__last")
    )
    carry = _carried(last, keys, F.lag("__last").over(across), "__carry")
    return (
        work.withColumn("__prev", F.lag(F.struct(*columns)).over(inside))
        .join(carry, [*keys, "__block"], "left")
        .withColumn(out, F.coalesce("__prev", "__carry"))
        .drop("__prev", "__carry", "__block")
    )


def running_sum(
    df: DataFrame, keys: list[str], order: str, value: str, out: str, block: int = BLOCK
) -> DataFrame:
    """Sum of an expression over all rows of the key up to and including this one."""
    return _running(df, keys, order, value, out, block, F.sum, lambda a, b: a + b, F.lit(0))


def running_max(
    df: DataFrame, keys: list[str], order: str, value: str, out: str, block: int = BLOCK
) -> DataFrame:
    """Largest value of an expression up to and including this row, null if none."""
    return _running(df, keys, order, value, out, block, F.max, F.greatest, F.lit(None))


def _running(df, keys, order, value, out, block, agg, combine, empty) -> DataFrame:
    work = _blocks(df, order, block).withColumn("__v", F.expr(value))
    inside = (
        Window.partitionBy(*keys, "__block").orderBy(order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    before = (
        Window.partitionBy(*keys).orderBy("__block")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    per_block = work.groupBy(*keys, "__block").agg(agg("__v").alias("__b"))
    carry = _carried(per_block, keys, F.coalesce(agg("__b").over(before), empty), "__carry")
    return (
        work.withColumn("__in", agg("__v").over(inside))
        .join(carry, [*keys, "__block"], "left")
        .withColumn(out, combine(F.col("__in"), F.col("__carry")))
        .drop("__v", "__in", "__carry", "__block")
    )


def failure_streaks(
    df: DataFrame, keys: list[str], order: str, failed: str = "failed", out: str = "streak"
) -> DataFrame:
    """Number of failures in a row at each event; a success starts again at zero.

    Failures so far minus failures at the latest success; both are running
    values, so no task ever needs all events of a key.
    """
    work = running_sum(df, keys, order, f"if({failed}, 1L, 0L)", "__fails")
    work = running_max(work, keys, order, f"if({failed}, null, __fails)", "__reset")
    return work.withColumn(
        out, F.col("__fails") - F.coalesce("__reset", F.lit(0))
    ).drop("__fails", "__reset")
