"""User analytics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hashwave.functions.text import normalise_handle
from hashwave.operators.users import (
    AVERAGE_FIELD,
    COUNTED_METRICS,
    for_handles,
    timeline,
    user_analytics,
    user_posts,
    with_user_profiles,
)


def user_page(
    tweets: DataFrame,
    profiles: DataFrame,
    handles: list[str] | None = None,
    n: int = 15,
    page_size: int = 200,
    pages: int = 3,
) -> DataFrame:
    """Five metrics and the profile per user, lists as JSON.

    A requested user without posts gets a NULL average and empty lists.
    """
    posts = for_handles(user_posts(tweets), handles)
    metrics = user_analytics(timeline(posts, page_size, pages), n)
    if handles is not None:
        named = tweets.sparkSession.createDataFrame([(h,) for h in handles], "handle string")
        wanted = named.select(normalise_handle(F.col("handle")).alias("user_handle")).distinct()
        metrics = wanted.join(metrics, "user_handle", "left")
    lists = [
        F.coalesce(F.to_json(field), F.lit("[]")).alias(field)
        for field, _ in COUNTED_METRICS.values()
    ]
    page = metrics.select("user_handle", AVERAGE_FIELD, *lists)
    return with_user_profiles(page, profiles)
