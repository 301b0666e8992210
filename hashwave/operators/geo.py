"""Where and when hashtags are used."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hashwave.functions.place import place_point, resolve_point
from hashwave.functions.text import entity_hashtags, normalise_tag, text_hashtags
from hashwave.functions.timing import (
    LIVE_COLOUR,
    LIVE_LABEL,
    LIVE_SLICE,
    colour_icon,
    legend_steps,
    slice_colour,
    time_slice,
    timebucket,
)
from hashwave.operators.filters import complete_rows, located, with_place
from hashwave.operators.joins import splittable_join
from hashwave.operators.numbering import numbered


def geo_uses(tweets: DataFrame) -> DataFrame:
    """One row per hashtag in the text of a post with a place: id, created_at, pos, hashtag, lat, lng."""
    lat, lng = place_point(F.col("place"))
    uses = with_place(tweets).select(
        "id",
        "created_at",
        lat.alias("lat"),
        lng.alias("lng"),
        F.posexplode(text_hashtags(F.col("text"))).alias("pos", "hashtag"),
    )
    return located(uses)


def live_points(tweets: DataFrame) -> DataFrame:
    """One row per parsed hashtag of a post with any point, lower-cased; keeps no state."""
    lat, lng = resolve_point(F.col("coordinates"), F.col("place"))
    uses = tweets.select(
        "id",
        "created_at",
        lat.alias("lat"),
        lng.alias("lng"),
        F.posexplode(entity_hashtags(F.col("entities"))).alias("pos", "tag"),
    )
    return located(uses).select(
        "id", "created_at", "pos", normalise_tag(F.col("tag")).alias("hashtag"), "lat", "lng"
    )


def point_rows(uses: DataFrame, bucket: str) -> DataFrame:
    """Every use with its time bucket: the grouped points as plain rows, without a shuffle."""
    return uses.select(
        "hashtag",
        timebucket(F.col("created_at"), bucket).alias("timebucket"),
        "id",
        "pos",
        F.col("created_at").alias("ts"),
        "lat",
        "lng",
    )


def hashtag_points(uses: DataFrame, bucket: str, parts: int = 8) -> DataFrame:
    """All (ts, lat, lng) of a hashtag in a time bucket, as arrays in time order.

    Every group is dealt over at most ``parts`` rows, numbered by ``part``, by its posts' ids. Choose
    ``parts`` so that the largest group over ``parts`` fits a row; it does not depend on the data.
    :func:`point_rows` has the same points without any shuffle or bound.
    """
    part = F.pmod(F.col("id") + F.col("pos"), F.lit(parts)).cast("long")
    return (
        point_rows(uses, bucket)
        .groupBy("hashtag", "timebucket", part.alias("part"))
        .agg(
            F.count("*").alias("uses"),
            F.sort_array(F.collect_list(F.struct("ts", "lat", "lng"))).alias("points"),
        )
    )


def point_chunks(uses: DataFrame, bucket: str, most: int = 10_000) -> DataFrame:
    """The same with at most ``most`` points a row, however many a hashtag has in a time bucket.

    The points of a group are numbered in the order of (time, id, position), and every ``most`` of them
    are a row: its parts follow one another in time, and only the last of a group is not full.
    """
    rows = numbered(point_rows(uses, bucket), ["hashtag", "timebucket"], ["ts", "id", "pos"])
    points = F.sort_array(F.collect_list(F.struct("number", "ts", "lat", "lng")))
    return rows.groupBy("hashtag", "timebucket", F.expr(f"number div {int(most)}").alias("part")).agg(
        F.count("*").alias("uses"),
        F.transform(points, lambda p: F.struct(p["ts"].alias("ts"), p["lat"].alias("lat"), p["lng"].alias("lng"))).alias("points"),
    )


def moment(instant: str) -> Column:
    """(instant, id) packed into one number.

    Aggregates over plain numbers are hashed, while those over structs make Spark sort all rows
    first. Rows of equal number belong to one post.
    """
    return F.expr(
        f"CAST(unix_micros({instant}) AS decimal(18, 0)) * 10000000000000000000BD "
        "+ CAST(id AS decimal(19, 0))"
    )


def newest_point(instant: str) -> list[Column]:
    """Aggregates giving the point of a group's last row by (instant, id)."""
    return [F.max_by(name, moment(instant)).alias(name) for name in ("lat", "lng")]


def latest_points(rows: DataFrame, last: list[Column]) -> DataFrame:
    """One point per (lower-cased hashtag, time bucket), picked by the given aggregates."""
    key = normalise_tag(F.col("hashtag")).alias("hashtag")
    return complete_rows(rows.groupBy(key, "timebucket").agg(*last))


def hashtag_geo_latest(uses: DataFrame, bucket: str) -> DataFrame:
    """The stored geo trend: the last point of each hashtag in each time bucket."""
    return latest_points(point_rows(uses, bucket), newest_point("ts"))


def hashtag_geo_newest(uses: DataFrame, bucket: str) -> DataFrame:
    """The same with the point's ``moment``, so that results of separate batches can be folded."""
    last = [F.max(moment("ts")).alias("moment"), *newest_point("ts")]
    return latest_points(point_rows(uses, bucket), last)


def latest_dumped_points(points: DataFrame) -> DataFrame:
    """The same from points without an id: the last by time, then the largest."""
    last = F.max(F.struct("ts", "lat", "lng"))
    fields = [last.getField(name).alias(name) for name in ("lat", "lng")]
    return latest_points(points, fields)


def hashtag_time_range(geo: DataFrame) -> DataFrame:
    """Oldest and newest time bucket of each hashtag."""
    return geo.groupBy("hashtag").agg(
        F.min("timebucket").alias("oldest"), F.max("timebucket").alias("newest")
    )


def ordered_by_time(geo: DataFrame) -> DataFrame:
    """Rows of each hashtag in time order. Sorts by ranges of both columns, so a hot hashtag
    is cut into several ranges."""
    return geo.orderBy("hashtag", "timebucket")


def with_slices(geo: DataFrame, ranges: DataFrame) -> DataFrame:
    """Each point with the range of its hashtag, its slice of that range, and the slice's colour.

    The range is joined back rather than taken over a window, which would gather a hot hashtag
    in one task.
    """
    placed = splittable_join(geo, ranges, ["hashtag"]).withColumn(
        "slice", time_slice("timebucket", "oldest", "newest")
    )
    coloured = placed.withColumn("colour", slice_colour("slice"))
    return coloured.withColumn("icon", colour_icon("colour"))


def hashtag_slices(geo: DataFrame) -> DataFrame:
    return with_slices(geo, hashtag_time_range(geo))


def with_legend(ranges: DataFrame) -> DataFrame:
    """Ranges (oldest, newest) with their six legend rows as an array column."""
    steps, legend = legend_steps(ranges)
    return steps.select(*ranges.columns, legend.alias("legend"))


def trend_legend(ranges: DataFrame) -> DataFrame:
    """Six legend rows per range."""
    # Exploded as an expression: from a column, Spark would repeat it in a filter on its size.
    steps, legend = legend_steps(ranges)
    return steps.select("hashtag", F.inline(legend))


def live_markers(live: DataFrame) -> DataFrame:
    """Live points in the live colour; works on tables and on streams."""
    return live.select(
        "hashtag",
        "lat",
        "lng",
        F.lit(LIVE_SLICE).alias("slice"),
        F.lit(LIVE_COLOUR).alias("colour"),
        F.lit(LIVE_LABEL).alias("label"),
    )


def trend_map(sliced: DataFrame, markers: DataFrame) -> DataFrame:
    """Recorded points in their slice colours together with live markers, which have no time bucket."""
    recorded = sliced.select("hashtag", "timebucket", "lat", "lng", "slice", "colour", "label")
    return recorded.unionByName(markers, allowMissingColumns=True)
