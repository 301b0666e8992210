"""Top-k rows per key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_per_key(
    df: DataFrame, keys: list[str], order: list[Column], k: int, rank: str = "rank"
) -> DataFrame:
    """The first k rows of each key by a total order, with their rank.

    Spark cuts every partition to k rows per key before the shuffle, so the task that ends up
    with a hot key sees at most k rows per input partition.
    """
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).where(F.col(rank) <= k)


def top_per_key_wide(
    df: DataFrame, keys: list[str], order: list[Column], k: int, rank: str = "rank", parts: int = 64
) -> DataFrame:
    """Same result, for input straight from a scan of very many splits.

    There k rows per split of one hot key can still be too much for one task. So the splits are
    dealt into parts, each part is cut to k rows per key by a task of its own, and the survivors
    are ranked. The parts follow the splits, not the rows, because a split then sends no more
    than k rows per key. As ``order`` must be total, the parts do not matter for the result. A hot
    key's last task sees up to k rows from each of the ``parts``.
    """
    if parts > 1:
        part = F.pmod(F.spark_partition_id(), F.lit(parts))
        df = top_per_key(df.withColumn("_part", part), [*keys, "_part"], order, k, "_part_rank")
        df = df.drop("_part", "_part_rank")
    return top_per_key(df, keys, order, k, rank)
