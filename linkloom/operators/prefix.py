"""Running sums over groups of any size without a single-task window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F


def prefix_sums(df: DataFrame, group: list[str], block: str, order: list[str | Column], value: str, out: str) -> DataFrame:
    """Add ``out``: the sum of ``value`` over the rows of ``group`` that come before a row in the order (block, order).

    Two levels keep every window bounded. Rows are summed per (group, block); a window over those few sums gives each
    block's start; a window inside a block adds the rest. ``block`` must be a column whose order agrees with the wanted
    order and that bounds the number of rows per (group, block), so a group with a third of all rows is spread over its
    blocks. Null ``value`` counts as 0, an empty table stays empty.
    """
    start, v = f"{out}__start", F.coalesce(F.col(value), F.lit(0))
    sums = df.groupBy(*group, block).agg(F.sum(v).alias("__sum"))
    before = W.partitionBy(*group).orderBy(block).rowsBetween(W.unboundedPreceding, -1)
    starts = sums.select(*group, block, F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias(start))
    inside = W.partitionBy(*group, block).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    local = df.withColumn(out, F.coalesce(F.sum(v).over(inside), F.lit(0)))
    return local.join(starts, [*group, block]).withColumn(out, F.col(out) + F.col(start)).drop(start)
