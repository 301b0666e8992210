"""Reading served tables by key, and adding to them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hashwave.functions.text import normalise_tag
from hashwave.operators.joins import splittable_join


def _keywords(spark: SparkSession, keywords: list[str] | DataFrame) -> DataFrame:
    if isinstance(keywords, DataFrame):
        return keywords.select(normalise_tag(F.col("keyword")).alias("hashtag")).distinct()
    rows = [(word.lower(),) for word in dict.fromkeys(keywords)]
    return spark.createDataFrame(rows, "hashtag string").distinct()


def lookup_hashtag(table: DataFrame, keywords: list[str] | DataFrame) -> DataFrame:
    """All rows of a table for some keywords, whatever their case.

    A list becomes a filter the Parquet scan can skip row groups by; a DataFrame a semi join.
    """
    if isinstance(keywords, DataFrame):
        wanted = _keywords(table.sparkSession, keywords)
        return splittable_join(table, wanted, ["hashtag"], "left_semi")
    return table.where(F.col("hashtag").isin([word.lower() for word in keywords]))


def lookup_hashtag_user(table: DataFrame, pairs: DataFrame) -> DataFrame:
    """Rows of a table for (hashtag, user_handle) pairs."""
    wanted = pairs.select(normalise_tag(F.col("hashtag")).alias("hashtag"), "user_handle").distinct()
    return table.join(wanted, ["hashtag", "user_handle"])


def keyword_status(trend: DataFrame, keywords: list[str] | DataFrame) -> DataFrame:
    """For each keyword, whether the trend has any row, and how many."""
    wanted = _keywords(trend.sparkSession, keywords)
    if not isinstance(keywords, DataFrame):
        trend = lookup_hashtag(trend, keywords)
    # Counted before the join, so a hot hashtag meets it as one row per task.
    found = trend.groupBy("hashtag").agg(F.count("*").alias("rows"))
    return wanted.join(found, "hashtag", "left").select(
        "hashtag",
        F.coalesce("rows", F.lit(0)).alias("rows"),
        F.col("rows").isNotNull().alias("has_data"),
    )


def one_per_key(batch: DataFrame, order: Column | None = None) -> DataFrame:
    """One row per (hashtag, timebucket): the last by ``order``, a number by which rows of one key differ, or without
    one the last by a hash of the point, so that reruns agree."""
    order = F.xxhash64("lat", "lng") if order is None else order
    return batch.groupBy("hashtag", "timebucket").agg(*(F.max_by(name, order).alias(name) for name in ("lat", "lng")))


def put_geo(stored: DataFrame, batch: DataFrame, order: Column | None = None) -> DataFrame:
    """The rows of a batch to insert: one per (hashtag, timebucket), and none already stored."""
    key = ["hashtag", "timebucket"]
    return one_per_key(batch, order).join(stored.select(*key), key, "left_anti")


def to_result_json(df: DataFrame, *columns: str) -> DataFrame:
    """One JSON document per row, from the named columns or all of them."""
    fields = columns or df.columns
    return df.select(F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("json"))
