"""Timelines and the metrics of their authors."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hashwave.functions.text import (
    avatar_url,
    entity_hashtags,
    entity_mentions,
    normalise_handle,
    optional_item,
)
from hashwave.operators.joins import splittable_join
from hashwave.operators.ranking import top_per_key, top_per_key_wide

# The result fields of the counted metrics and the name each gives its items.
AVERAGE_FIELD = "an1"
COUNTED_METRICS = {
    "hashtags": ("an2", "hashtag"),
    "mentions": ("an3", "person"),
    "replies": ("an4", "screen_name"),
    "locations": ("an5", "location"),
}

_SCORE = "score"


def user_posts(tweets: DataFrame) -> DataFrame:
    """The columns of a post the metrics need, by lower-cased author, items as arrays."""
    reply = F.col("in_reply_to_screen_name")
    place = F.col("place")
    return tweets.where(F.col("user").isNotNull()).select(
        normalise_handle(F.col("user.screen_name")).alias("user_handle"),
        "id",
        "retweet_count",
        entity_hashtags(F.col("entities")).alias("hashtags"),
        entity_mentions(F.col("entities")).alias("mentions"),
        optional_item(reply.isNotNull(), F.trim(reply)).alias("replies"),
        optional_item(place.isNotNull(), place.getField("full_name")).alias("locations"),
    )


def for_handles(posts: DataFrame, handles: list[str] | None) -> DataFrame:
    """Posts of the named users, or of all users."""
    if handles is None:
        return posts
    wanted = [normalise_handle(F.lit(handle)) for handle in handles]
    return posts.where(F.col("user_handle").isin(wanted))


def timeline(
    posts: DataFrame, page_size: int = 200, pages: int = 3, parts: int = 64
) -> DataFrame:
    """Each user's newest posts, numbered and paged."""
    newest = top_per_key_wide(
        posts, ["user_handle"], [F.col("id").desc()], page_size * pages, "rn", parts
    )
    page = F.floor((F.col("rn") - 1) / page_size) + 1
    return newest.withColumn("page", page.cast("int"))


def write_user_posts(posts: DataFrame, path: str) -> None:
    """Store posts by author, the newest first, so that :func:`next_page` skips what lies before a page and other authors."""
    order = ["user_handle", F.col("id").desc()]
    posts.repartitionByRange(*order).sortWithinPartitions(*order).write.option(
        "parquet.bloom.filter.enabled#user_handle", "true"
    ).parquet(path)


def next_page(posts: DataFrame, last: dict[str, int | None] | DataFrame | None, size: int = 200) -> DataFrame:
    """The ``size`` posts of each author that follow the last one seen, numbered by ``place`` from the newest.

    ``last`` names authors with the id of the last post that was seen, or null for the first page: as a dict, which
    becomes a filter that skips row groups, or as a table (``user_handle``, ``last_id``). None stands for the first
    page of all authors. Posts that arrive meanwhile do not shift the pages. Null ids are on no page.
    """
    if isinstance(last, dict):
        wanted = [
            (F.col("user_handle") == normalise_handle(F.lit(handle))) & (F.lit(True) if id is None else F.col("id") < id)
            for handle, id in last.items()
        ]
        posts = posts.where(reduce(Column.__or__, wanted, F.lit(False)))
    elif last is not None:
        seen = last.groupBy("user_handle").agg(F.min("last_id").alias("_last"))
        posts = splittable_join(posts, seen, ["user_handle"]).where("_last is null or id < _last").drop("_last")
    return top_per_key(posts.where("id is not null"), ["user_handle"], [F.col("id").desc()], size, "place")


def user_avg_retweets(tl: DataFrame) -> DataFrame:
    """Average reshares per post of a timeline."""
    return tl.groupBy("user_handle").agg(_average(F.count("*"), F.sum("retweet_count")))


def _average(posts: Column, reshares: Column) -> Column:
    return (F.coalesce(reshares, F.lit(0)).cast("double") / posts).alias("avg_retweets")


def _items(metrics: list[str], score: bool = False) -> Column:
    """The countable items of a post as one array, with the post's own score in front if wanted."""
    lists = [
        f"""transform({metric}, (item, pos) -> struct(
                '{metric}' AS metric, item, bigint(pos) AS pos, CAST(NULL AS bigint) AS score))"""
        for metric in metrics
    ]
    if score:
        own = "coalesce(retweet_count, 0L)"
        lists.insert(
            0, f"array(struct('{_SCORE}' AS metric, CAST(NULL AS string) AS item, 0L AS pos, {own} AS score))"
        )
    return F.expr(f"concat({', '.join(lists)})")


def _count_items(tl: DataFrame, items: Column) -> DataFrame:
    rows = tl.select("user_handle", "rn", F.inline(items))
    # Post number and position within the post in one sortable number.
    seen = F.expr("min(shiftleft(bigint(rn), 32) | pos)")
    return rows.groupBy("user_handle", "metric", "item").agg(
        F.count("*").alias("count"), seen.alias("first_seen"), F.sum("score").alias("score")
    )


def item_counts(tl: DataFrame, metrics: list[str] | None = None) -> DataFrame:
    """How often each user used each item of the named metrics, with its first appearance.

    A timeline is already partitioned by user and bounded per user, so nothing here shuffles.
    """
    return _count_items(tl, _items(metrics or list(COUNTED_METRICS))).drop("score")


def _single(tl: DataFrame, metric: str) -> DataFrame:
    name = COUNTED_METRICS[metric][1]
    return item_counts(tl, [metric]).select(
        "user_handle", F.col("item").alias(name), "count", "first_seen"
    )


def user_hashtags(tl: DataFrame) -> DataFrame:
    return _single(tl, "hashtags")


def user_mentions(tl: DataFrame) -> DataFrame:
    return _single(tl, "mentions")


def user_replies(tl: DataFrame) -> DataFrame:
    return _single(tl, "replies")


def user_locations(tl: DataFrame) -> DataFrame:
    return _single(tl, "locations")


def top_n(counts: DataFrame, n: int = 15) -> DataFrame:
    """The n most frequent items per user (and metric, where there are several)."""
    keys = [name for name in ("user_handle", "metric") if name in counts.columns]
    return top_per_key(counts, keys, [F.col("count").desc(), F.col("first_seen").asc()], n)


def with_shares(top: DataFrame) -> DataFrame:
    """Each kept item's share of the kept total of its user and metric, in percent."""
    keys = [name for name in ("user_handle", "metric") if name in top.columns]
    total = F.sum("count").over(Window.partitionBy(*keys))
    share = F.when(total == 0, F.lit(0.0)).otherwise(F.col("count") / total * 100)
    shares = top.withColumn("share_pct", share)
    return shares.withColumn("share_label", F.format_number("share_pct", 1))


def user_analytics(tl: DataFrame, n: int = 15) -> DataFrame:
    """All five metrics of a user in one row: the average and four top-n lists.

    Everything is counted in one pass over the timeline, whose partitioning by user serves every
    later step.
    """
    top = top_n(_count_items(tl, _items(list(COUNTED_METRICS), score=True)), n)

    def listed(metric: str) -> Column:
        field, name = COUNTED_METRICS[metric]
        entries = f"collect_list(struct(rank, item, count)) FILTER (WHERE metric = '{metric}')"
        named = f"transform(sort_array({entries}), e -> struct(e.item AS {name}, e.count))"
        return F.expr(named).alias(field)

    average = F.expr(f"max(double(score) / count) FILTER (WHERE metric = '{_SCORE}')")
    return top.groupBy("user_handle").agg(
        average.alias(AVERAGE_FIELD), *map(listed, COUNTED_METRICS)
    )


def with_user_profiles(metrics: DataFrame, profiles: DataFrame) -> DataFrame:
    """Attach followers, following, description and large image; missing profiles give NULLs.

    Of several profiles whose handles differ in case alone, one stays.
    """
    handle = normalise_handle(F.col("screen_name")).alias("user_handle")
    facts = F.struct(
        "followers_count",
        F.col("friends_count").alias("following_count"),
        "description",
        avatar_url(F.col("profile_image_url")).alias("avatar_url"),
    )
    once = profiles.groupBy(handle).agg(F.min(facts).alias("facts")).select("user_handle", "facts.*")
    return metrics.join(once, "user_handle", "left")
