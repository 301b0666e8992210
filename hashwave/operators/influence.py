"""Whose posts about a hashtag get reshared."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hashwave.functions.text import avatar_url, normalise_handle, normalise_tag, text_hashtags
from hashwave.functions.timing import timebucket
from hashwave.operators.filters import reshares_only
from hashwave.operators.ranking import top_per_key


def reshare_uses(tweets: DataFrame) -> DataFrame:
    """One row per hashtag in the text of a reshare, with the original author and the resharer."""
    return reshares_only(tweets).select(
        "id",
        "created_at",
        F.col("retweeted_status.user.screen_name").alias("user_handle"),
        F.col("user.screen_name").alias("reshared_by"),
        F.posexplode(text_hashtags(F.col("text"))).alias("pos", "hashtag"),
    )


def retweet_counts(uses: DataFrame, bucket: str) -> DataFrame:
    """Occurrences per (hashtag, original author) in each time bucket."""
    return uses.groupBy(
        timebucket(F.col("created_at"), bucket).alias("timebucket"), "hashtag", "user_handle"
    ).agg(F.count("*").alias("count"))


def running_influencers(uses: DataFrame) -> DataFrame:
    """Occurrences per (lower-cased hashtag, original author) over all time."""
    return uses.groupBy(normalise_tag(F.col("hashtag")).alias("hashtag"), "user_handle").agg(
        F.count("*").alias("count")
    )


def sum_counts(counts: DataFrame) -> DataFrame:
    """Counts of any batches added up into totals per (lower-cased hashtag, original author)."""
    return counts.groupBy(normalise_tag(F.col("hashtag")).alias("hashtag"), "user_handle").agg(
        F.sum("count").alias("count")
    )


def accumulate_counts(stored: DataFrame, batch: DataFrame) -> DataFrame:
    """Stored totals plus the counts of a new batch, absent keys inserted."""
    columns = ["hashtag", "user_handle", "count"]
    return sum_counts(stored.select(*columns).unionByName(batch.select(*columns)))


def distinct_resharers(uses: DataFrame) -> DataFrame:
    """How many different people reshared an author under a hashtag."""
    return uses.groupBy(normalise_tag(F.col("hashtag")).alias("hashtag"), "user_handle").agg(
        F.count_distinct("reshared_by").alias("people")
    )


def approx_distinct_resharers(uses: DataFrame, rsd: float = 0.05) -> DataFrame:
    """The same from a fixed-size sketch per key; also runs on streams."""
    return uses.groupBy(normalise_tag(F.col("hashtag")).alias("hashtag"), "user_handle").agg(
        F.approx_count_distinct("reshared_by", rsd).alias("people")
    )


#: Sketches of 2^12 registers: three standard errors of an estimate, as a share of it.
SKETCH_BITS = 12
SKETCH_ERROR = 3 * 1.04 / 2 ** (SKETCH_BITS / 2)


def resharer_sketches(uses: DataFrame) -> DataFrame:
    """The different people of each (lower-cased hashtag, author) as a sketch of bounded size; sketches of batches can be united."""
    return uses.groupBy(normalise_tag(F.col("hashtag")).alias("hashtag"), "user_handle").agg(
        F.hll_sketch_agg("reshared_by", F.lit(SKETCH_BITS)).alias("sketch")
    )


def sketched_resharers(sketches: DataFrame) -> DataFrame:
    """About how many different people each sketch has seen, within ``SKETCH_ERROR``."""
    return sketches.select("hashtag", "user_handle", F.hll_sketch_estimate("sketch").alias("people"))


def top_influencers(totals: DataFrame, k: int = 3) -> DataFrame:
    """The k most reshared authors per hashtag, ties by handle."""
    order = [F.col("count").desc(), F.col("user_handle").asc()]
    return top_per_key(totals, ["hashtag"], order, k)


def with_profiles(top: DataFrame, profiles: DataFrame) -> DataFrame:
    """Attach the large profile image; an author without a profile keeps a NULL one.

    Of several profiles whose handles differ in case alone, one image stays.

    No broadcast hint: Spark broadcasts the profiles while they are below its size threshold, and
    otherwise joins by shuffle.
    """
    images = profiles.select(
        normalise_handle(F.col("screen_name")).alias("_handle"),
        avatar_url(F.col("profile_image_url")).alias("avatar_url"),
    )
    images = images.groupBy("_handle").agg(F.min("avatar_url").alias("avatar_url"))
    joined = top.join(images, normalise_handle(top["user_handle"]) == images["_handle"], "left")
    return joined.drop("_handle")
