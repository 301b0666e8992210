"""Hashtag trend and live trend."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hashwave.operators import geo as ops
from hashwave.operators.lookups import lookup_hashtag


Keywords = list[str] | DataFrame | None


def _points_and_ranges(geo: DataFrame, keywords: Keywords) -> tuple[DataFrame, DataFrame]:
    """Points, and the time range of every wanted hashtag.

    Listed keywords filter the scan. Keywords from a table pick ranges, which are one row per
    hashtag; the points meet them only in the join that attaches the range.
    """
    if isinstance(keywords, list):
        geo = lookup_hashtag(geo, keywords)
    ranges = ops.hashtag_time_range(geo)
    if isinstance(keywords, DataFrame):
        ranges = lookup_hashtag(ranges, keywords)
    return geo, ranges


def hashtag_trend(geo: DataFrame, keywords: Keywords = None) -> DataFrame:
    """Every recorded point of the hashtags with its slice, colour, legend label and JSON form."""
    points, ranges = _points_and_ranges(geo, keywords)
    sliced = ops.with_slices(points, ops.with_legend(ranges))
    label = F.expr("get(legend, slice - 1).name")
    point = F.to_json(F.struct("timebucket", "lat", "lng"))
    return sliced.withColumn("label", label).withColumn("point", point).drop("legend")


def hashtag_legend(geo: DataFrame, keywords: Keywords = None) -> DataFrame:
    """The legend rows that go with :func:`hashtag_trend`."""
    return ops.trend_legend(_points_and_ranges(geo, keywords)[1])


def live_markers(live: DataFrame, keywords: Keywords = None) -> DataFrame:
    """The live side of the map. On a stream, store the markers and read them for :func:`trend_map`."""
    if keywords is not None:
        live = lookup_hashtag(live, keywords)
    return ops.live_markers(live)


def trend_map(geo: DataFrame, markers: DataFrame, keywords: Keywords = None) -> DataFrame:
    """Recorded points and stored live markers on one map."""
    return ops.trend_map(hashtag_trend(geo, keywords), markers)


def live_trend(geo: DataFrame, live: DataFrame, keywords: Keywords = None) -> DataFrame:
    """Recorded points and a table of live points on one map."""
    return trend_map(geo, live_markers(live, keywords), keywords)
