"""Row filters on posts and on trend rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hashwave.functions.place import WORLD_BOX, in_box


def posts_only(messages: DataFrame) -> DataFrame:
    """Drop control messages, which carry no author."""
    return messages.where(F.col("user").isNotNull())


def with_place(tweets: DataFrame) -> DataFrame:
    return tweets.where(F.col("place").isNotNull())


def reshares_only(tweets: DataFrame) -> DataFrame:
    return tweets.where(F.col("retweeted_status").isNotNull())


def located(points: DataFrame) -> DataFrame:
    return points.where(F.col("lat").isNotNull() & F.col("lng").isNotNull())


def complete_rows(trend: DataFrame) -> DataFrame:
    """Trend rows that may be stored: a hashtag, a time bucket and a point."""
    return located(trend).where((F.col("hashtag") != "") & (F.col("timebucket") != 0))


def bbox_filter(
    points: DataFrame,
    west: float = WORLD_BOX[0],
    south: float = WORLD_BOX[1],
    east: float = WORLD_BOX[2],
    north: float = WORLD_BOX[3],
) -> DataFrame:
    """Points inside a longitude/latitude box, edges included."""
    return points.where(in_box(F.col("lat"), F.col("lng"), west, south, east, north))
