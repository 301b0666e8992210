"""Old text dumps, one folder per batch, and how to write them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The shapes of the dump records and of a batch folder, "-<milliseconds>.<suffix>".
GROUP_END = ")))"
GROUP_TAG = r"(?s)^\s*\((.*?),ArrayBuffer\("
GROUP_POINT = r"\(([A-Z][a-z]{2} [A-Z][a-z]{2} \d{2} [0-9:]{8} UTC \d{4},[^),]*,[^),]*)"
POINT_DATE = "MMM dd HH:mm:ss 'UTC' yyyy"
WEEKDAYS = ["Mon", "Tue", "Wed", "Thu", "Fri", "Sat", "Sun"]
BATCH_FOLDER = r"[/=]-(\d+)\d{3}\.[^/]*/"


def path_timebucket(path: Column) -> Column:
    """Epoch seconds of the batch a dump file belongs to."""
    return F.regexp_extract(path, BATCH_FOLDER, 1).try_cast("bigint")


def _text(spark: SparkSession, path: str, record_end: str) -> DataFrame:
    reader = spark.read.option("recursiveFileLookup", "true").option("lineSep", record_end)
    return reader.text(path).select(
        "value", path_timebucket(F.col("_metadata.file_path")).alias("timebucket")
    )


def backfill_geo(spark: SparkSession, path: str) -> DataFrame:
    """Points of a geo dump: hashtag, timebucket, ts, lat, lng.

    A record is ``(tag,ArrayBuffer((date,lat,lng), (date,lat,lng)))`` and may span lines, as a
    hashtag can hold a line break. Records without a readable point give no rows.
    """
    records = _text(spark, path, GROUP_END)
    points = records.select(
        "timebucket",
        F.lower(F.regexp_extract("value", GROUP_TAG, 1)).alias("hashtag"),
        F.explode(F.regexp_extract_all("value", F.lit(GROUP_POINT), F.lit(1))).alias("point"),
    )
    part = F.split(F.col("point"), ",")
    return points.select(
        "hashtag",
        "timebucket",
        F.try_to_timestamp(F.substr(part[0], F.lit(5)), F.lit(POINT_DATE)).alias("ts"),
        F.trim(part[1]).try_cast("double").alias("lat"),
        F.trim(part[2]).try_cast("double").alias("lng"),
    ).where((F.col("hashtag") != "") & F.col("lat").isNotNull() & F.col("lng").isNotNull())


def backfill_influencers(spark: SparkSession, path: str) -> DataFrame:
    """Counts of an influencer dump: hashtag, timebucket, user_handle, count.

    A line is ``((tag,handle),count)``. The tag ends at its first comma, the handle starts after
    the last one; lines with more or fewer closing marks are dropped.
    """
    pieces = F.split(F.col("value"), r"\)")
    names = F.split(F.get(pieces, F.lit(0)), ",")
    lines = _text(spark, path, "\n").where(F.size(pieces) == 3)
    return lines.select(
        F.lower(F.substr(F.get(names, F.lit(0)), F.lit(3))).alias("hashtag"),
        "timebucket",
        F.element_at(names, -1).alias("user_handle"),
        F.trim(F.substr(F.get(pieces, F.lit(1)), F.lit(2))).try_cast("bigint").alias("count"),
    ).where(F.col("count").isNotNull())


def _write(lines: DataFrame, path: str, suffix: str) -> None:
    batch = F.format_string(f"-%d000.{suffix}", F.col("timebucket"))
    # Gathers small batches into few files and splits a large one over several tasks.
    (
        lines.select(batch.alias("batch"), "value")
        .hint("rebalance", "batch")
        .write.partitionBy("batch")
        .mode("overwrite")
        .text(path)
    )


def dump_geo(groups: DataFrame, path: str, suffix: str = "geo") -> None:
    """Write grouped points in the geo dump format."""

    def point(p: Column) -> Column:
        day = F.get(F.array(*map(F.lit, WEEKDAYS)), F.weekday(p["ts"]))
        date = F.concat_ws(" ", day, F.date_format(p["ts"], POINT_DATE))
        return F.concat(F.lit("("), F.concat_ws(",", date, p["lat"], p["lng"]), F.lit(")"))

    text = F.array_join(F.transform("points", point), ", ")
    line = F.concat(F.lit("("), "hashtag", F.lit(",ArrayBuffer("), text, F.lit("))"))
    _write(groups.select("timebucket", line.alias("value")), path, suffix)


def dump_influencers(counts: DataFrame, path: str, suffix: str = "counts") -> None:
    """Write counts in the influencer dump format."""
    line = F.format_string("((%s,%s),%d)", "hashtag", "user_handle", "count")
    _write(counts.select("timebucket", line.alias("value")), path, suffix)
