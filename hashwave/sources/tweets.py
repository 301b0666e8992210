"""Posts and profiles, from files or a message stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hashwave.operators.filters import posts_only
from hashwave.schemas import PROFILE, RAW_TWEET, TWEET

# Fixed value: how a post writes its time after the day name, "Apr 06 20:00:00 +0000 2015".
CREATED_AT_FORMAT = "MMM dd HH:mm:ss Z yyyy"


def parse_created_at(text: Column) -> Column:
    """The instant of "Mon Apr 06 20:00:00 +0000 2015"; NULL when it does not read like that."""
    return F.try_to_timestamp(F.substr(text, F.lit(5)), F.lit(CREATED_AT_FORMAT))


def _typed(raw: DataFrame) -> DataFrame:
    return posts_only(raw).withColumn("created_at", parse_created_at(F.col("created_at")))


def to_messages(tweets: DataFrame) -> DataFrame:
    """Posts as JSON messages in one column ``value``, as :func:`read_tweets` reads them."""
    created = F.date_format("created_at", f"EEE {CREATED_AT_FORMAT}")
    return tweets.withColumn("created_at", created).select(F.to_json(F.struct(*TWEET.fieldNames())).alias("value"))


def read_tweets(spark: SparkSession, path: str | list[str], format: str = "json") -> DataFrame:
    """Posts from JSON messages, whose control messages are dropped, or from a typed table.

    A typed table holds posts only, so it is not filtered: that would read the author's columns
    in jobs that do not need them.
    """
    if format == "json":
        return _typed(spark.read.schema(RAW_TWEET).json(path))
    return spark.read.schema(TWEET).format(format).load(path)


def stream_tweets(
    spark: SparkSession, path: str, format: str = "json", max_files: int | None = None
) -> DataFrame:
    """The same as a stream over the files that arrive in a folder."""
    reader = spark.readStream
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    if format == "json":
        return _typed(reader.schema(RAW_TWEET).json(path))
    return reader.schema(TWEET).format(format).load(path)


def decode_tweets(messages: DataFrame, column: str = "value") -> DataFrame:
    """Posts from a column of JSON messages, as a message queue delivers them."""
    parsed = F.from_json(F.col(column).cast("string"), RAW_TWEET)
    return _typed(messages.select(parsed.alias("post")).select("post.*"))


def stream_kafka_tweets(spark: SparkSession, options: dict[str, str]) -> DataFrame:
    """Posts from Kafka; needs Spark's Kafka connector on the class path."""
    return decode_tweets(spark.readStream.format("kafka").options(**options).load())


def read_profiles(spark: SparkSession, path: str, format: str = "parquet") -> DataFrame:
    return spark.read.schema(PROFILE).format(format).load(path)
