"""Row numbers without a window over the rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hashwave.session import stored


def numbered(rows: DataFrame, keys: list[str], order: list[str | Column], name: str = "number") -> DataFrame:
    """Number the rows of each key from 0, in the given order, as column ``name``.

    A window would gather a hot key in one task. Here the rows are dealt into ranges of key and order, so
    that a hot key covers several; every range is sorted and stored, and a row's number is its place
    in its range plus the rows of the key in the ranges before. What is summed up has one row per key and range.

    Null keys are a key of their own, and nulls come first in the order. Rows equal in key and order are numbered as
    they come; they stay in one range, so let the order end with something that tells them apart.
    An empty table has no numbers. Columns ``_place``, ``_range`` and ``name`` of the input are replaced.
    """
    rows = rows.drop("_place", "_range", name)
    # The greater half of a place is its range's number, the lesser one counts within the range.
    placed = rows.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order)
    placed = stored(placed.withColumn("_place", F.monotonically_increasing_id()), "numbered")
    of = F.shiftright("_place", 33).alias("_range")
    ranges = placed.groupBy(*keys, of).agg(F.min("_place").alias("_first"), F.count("*").alias("_n"))
    earlier = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("_n").over(earlier), F.lit(0)) - F.col("_first")
    starts = ranges.select(*(F.col(k).alias(f"_of_{k}") for k in keys), "_range", before.alias("_before"))
    same = [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in keys]
    where = reduce(Column.__and__, same, F.shiftright("_place", 33) == F.col("_range"))
    number = (F.col("_place") + F.col("_before")).alias(name)
    return placed.join(starts, where).select(*rows.columns, number)
