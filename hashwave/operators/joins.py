"""A join that stays splittable."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def splittable_join(
    left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner"
) -> DataFrame:
    """Join where the left side may hold a hot key and the right side is grouped by the keys.

    Spark splits a skewed join partition at run time, but only where both sides were shuffled for
    the join. A side grouped by the join keys would be used as it lies, which keeps a hot key of
    the other side in one task. A second key, derived from the first, makes both sides shuffle
    for the join; the right side has one row per key, so that costs little. The second key is one bit, which
    compresses well.
    """
    spread = F.xxhash64(*keys).bitwiseAND(F.lit(1))
    return (
        left.withColumn("_spread", spread)
        .join(right.withColumn("_spread", spread), [*keys, "_spread"], how)
        .drop("_spread")
    )
