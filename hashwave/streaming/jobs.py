"""Streaming forms of the trend and influencer operators.

Intervals follow the time of the post, not of its arrival, so a replay gives the same result. The
watermark is set on the rows that are grouped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, GroupedData
from pyspark.sql import functions as F

from hashwave.functions.text import normalise_tag
from hashwave.operators.filters import complete_rows
from hashwave.operators.geo import geo_uses, live_points, newest_point
from hashwave.operators.influence import reshare_uses, running_influencers


def _by_window(
    uses: DataFrame, bucket: str, delay: str | None, *keys: str | Column
) -> GroupedData:
    if delay is not None:
        uses = uses.withWatermark("created_at", delay)
    return uses.groupBy(F.window("created_at", bucket).alias("interval"), *keys)


def _bucket_end() -> Column:
    return F.unix_seconds(F.col("interval.end")).alias("timebucket")


def stream_geo(
    tweets: DataFrame, bucket: str = "1 second", delay: str | None = "10 seconds"
) -> DataFrame:
    """The stored geo trend as a stream: the last point per hashtag and interval, emitted once."""
    tag = normalise_tag(F.col("hashtag")).alias("hashtag")
    grouped = _by_window(geo_uses(tweets), bucket, delay, tag).agg(*newest_point("created_at"))
    return complete_rows(grouped.select("hashtag", _bucket_end(), "lat", "lng"))


def stream_influencers(
    tweets: DataFrame, bucket: str = "15 minutes", delay: str | None = "15 minutes"
) -> DataFrame:
    """Occurrences per hashtag and original author in each interval, emitted once."""
    grouped = _by_window(reshare_uses(tweets), bucket, delay, "hashtag", "user_handle")
    return grouped.agg(F.count("*").alias("count")).select(
        "hashtag", "user_handle", _bucket_end(), "count"
    )


def stream_running(tweets: DataFrame) -> DataFrame:
    """Running totals per hashtag and original author, for update or complete output.

    The state holds every pair ever seen. Where that is not wanted, store the counts of each
    interval instead and add them up on reading.
    """
    return running_influencers(reshare_uses(tweets))


def stream_live(tweets: DataFrame, keyword: str | None = None) -> DataFrame:
    """Live points, of one hashtag or of all; keeps no state."""
    points = live_points(tweets).select("hashtag", "lat", "lng", "id", "pos")
    return points if keyword is None else points.where(F.col("hashtag") == keyword.lower())


def put_once(rows: DataFrame, event_time: str, delay: str) -> DataFrame:
    """Let each (hashtag, timebucket) pass once, for input that may be delivered again."""
    return rows.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(
        ["hashtag", "timebucket"]
    )
