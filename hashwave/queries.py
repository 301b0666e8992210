"""The registered queries: every operator over the whole of the given tables.

Posts are derived from the event table (see ``sources/event_posts.py``). Times leave as epoch
seconds and nested values as JSON, so the results compare exactly with SQL.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hashwave.functions.text import avatar_url, normalise_handle
from hashwave.functions.timing import UNIT_SECONDS, humanize_seconds
from hashwave.operators import filters, geo, influence, lookups, users
from hashwave.plans import influencers as influencer_plans
from hashwave.plans import trends, users as user_plans
from hashwave.session import prepare, shared_dir, stored, use_rocksdb_state
from hashwave.sources import dumps, tables, tweets
from hashwave.sources.event_posts import (
    REPLAY_SLICES,
    closing_event,
    event_posts,
    event_profiles,
    read_events,
    read_nations,
    stream_event_posts,
    write_arrivals,
)
from hashwave.streaming import jobs, sinks

Query = Callable[[SparkSession, str], DataFrame]

KEYWORDS = ["CLICK", "k3", "nosuchtag"]
HANDLES = ["@User1", "user17", "nosuchuser"]
GEO_BUCKET = "1 hour"
COUNT_BUCKET = "15 minutes"
DELAY = "1 hour"
BOX = (-120.0, -60.0, 100.0, 45.5)
FIRST_HALF_ENDS = "2024-01-16 12:00:00"

_REGISTRY: dict[str, Query] = {}


def query(build: Query) -> Query:
    """Register a query under the name of its function."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return build(prepare(spark), str(sf_dir).rstrip("/"))

    _REGISTRY[build.__name__] = run
    return run


def registered() -> dict[str, Query]:
    return dict(_REGISTRY)


def _seconds(name: str) -> Column:
    return F.unix_seconds(name).alias(name)


def _geo_uses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return geo.geo_uses(event_posts(spark, sf_dir))


def _geo_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return geo.hashtag_geo_latest(_geo_uses(spark, sf_dir), GEO_BUCKET)


def _reshares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return influence.reshare_uses(event_posts(spark, sf_dir))


def _totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return influence.running_influencers(_reshares(spark, sf_dir))


def _timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return users.timeline(users.user_posts(event_posts(spark, sf_dir)))


# Sources, filters and projections


def _flat(posts: DataFrame) -> DataFrame:
    lat, lng = (F.col("coordinates.coordinates")[i] for i in (1, 0))
    return posts.select(
        "id",
        _seconds("created_at"),
        "text",
        "retweet_count",
        F.col("user.screen_name").alias("screen_name"),
        "in_reply_to_screen_name",
        lat.alias("pt_lat"),
        lng.alias("pt_lng"),
        F.col("place.full_name").alias("place_full_name"),
        F.col("retweeted_status.user.screen_name").alias("orig_screen_name"),
        F.to_json("entities.hashtags").alias("hashtags"),
        F.to_json("entities.user_mentions").alias("user_mentions"),
    )


@query
def tweets_flat(spark, sf_dir):
    return _flat(filters.posts_only(event_posts(spark, sf_dir)))


def _message_files(spark: SparkSession, sf_dir: str) -> str:
    """A folder with all posts as JSON messages, and a control message for every event of a user divisible by 3."""
    path = shared_dir(spark, "messages")
    deleted = read_events(spark, sf_dir).where("user_id % 3 = 0")
    control = deleted.select(F.to_json(F.struct(F.struct("event_id").alias("delete"))).alias("value"))
    tweets.to_messages(event_posts(spark, sf_dir)).unionByName(control).write.text(path)
    return path


@query
def read_tweets_json(spark, sf_dir):
    return _flat(tweets.read_tweets(spark, _message_files(spark, sf_dir)))


@query
def decode_tweets(spark, sf_dir):
    return _flat(tweets.decode_tweets(spark.read.text(_message_files(spark, sf_dir))))


@query
def stream_tweets_json(spark, sf_dir):
    path = shared_dir(spark, "stream-tweets")
    posts = _flat(tweets.stream_tweets(spark, _message_files(spark, sf_dir)))
    sinks.write_batches(posts, f"{path}/table", f"{path}/checkpoint", every=None).awaitTermination()
    return spark.read.schema(posts.schema).parquet(f"{path}/table")


@query
def text_hashtags(spark, sf_dir):
    return _geo_uses(spark, sf_dir).select("id", "pos", "hashtag", "lat", "lng")


@query
def geo_points(spark, sf_dir):
    points = geo.live_points(event_posts(spark, sf_dir))
    return filters.bbox_filter(points, *BOX).select("id", "pos", "hashtag", "lat", "lng")


@query
def geo_points_world(spark, sf_dir):
    points = geo.live_points(event_posts(spark, sf_dir))
    return filters.bbox_filter(points).select("id", "pos", "hashtag", "lat", "lng")


@query
def point_rows(spark, sf_dir):
    rows = geo.point_rows(_geo_uses(spark, sf_dir), "1 second")
    return rows.withColumn("ts", _seconds("ts"))


def _flat_profiles(rows: DataFrame) -> DataFrame:
    return rows.select(
        normalise_handle(F.concat(F.lit("@"), F.upper("screen_name"))).alias("user_handle"),
        avatar_url(F.col("profile_image_url")).alias("avatar_url"),
        "description",
        "followers_count",
        "friends_count",
    )


@query
def profiles(spark, sf_dir):
    return _flat_profiles(event_profiles(spark, sf_dir))


@query
def read_profiles(spark, sf_dir):
    path = shared_dir(spark, "profiles")
    event_profiles(spark, sf_dir).write.parquet(path)
    return _flat_profiles(tweets.read_profiles(spark, path))


# Geography of hashtags


def _points_json(groups: DataFrame) -> DataFrame:
    points = F.transform(
        "points",
        lambda p: F.struct(F.unix_seconds(p["ts"]).alias("ts"), p["lat"].alias("lat"), p["lng"].alias("lng")),
    )
    return groups.withColumn("points", F.to_json(points))


@query
def hashtag_points(spark, sf_dir):
    return _points_json(geo.hashtag_points(_geo_uses(spark, sf_dir), GEO_BUCKET))


@query
def hashtag_points_split(spark, sf_dir):
    groups = geo.hashtag_points(_geo_uses(spark, sf_dir), "1 day", parts=25)
    return _points_json(groups)


@query
def point_chunks(spark, sf_dir):
    return _points_json(geo.point_chunks(_geo_uses(spark, sf_dir), "1 day"))


@query
def point_chunks_small(spark, sf_dir):
    return _points_json(geo.point_chunks(_geo_uses(spark, sf_dir), "1 day", most=7))


@query
def hashtag_geo_latest(spark, sf_dir):
    return _geo_trend(spark, sf_dir)


@query
def hashtag_time_range(spark, sf_dir):
    return geo.hashtag_time_range(_geo_trend(spark, sf_dir))


@query
def ordered_scan(spark, sf_dir):
    return geo.ordered_by_time(_geo_trend(spark, sf_dir))


@query
def hashtag_slices(spark, sf_dir):
    return geo.hashtag_slices(_geo_trend(spark, sf_dir))


@query
def trend_legend(spark, sf_dir):
    return geo.trend_legend(_legend_ranges(spark, sf_dir))


def _legend_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranges short enough for labels to clash, one per event."""
    start = F.unix_seconds(F.col("ts").cast("timestamp"))
    return read_events(spark, sf_dir).select(
        F.concat_ws("_", "event_type", "event_id").alias("hashtag"),
        start.alias("oldest"),
        (start + F.col("event_id") * 37 % 400000).alias("newest"),
    )


@query
def duration_labels(spark, sf_dir):
    ranges = _legend_ranges(spark, sf_dir)
    return ranges.withColumn("length", (F.col("newest") - F.col("oldest")) / 7).select(
        "hashtag",
        humanize_seconds("length").alias("auto_label"),
        *[humanize_seconds("length", unit).alias(f"{unit}_label") for unit in UNIT_SECONDS],
    )


@query
def hashtag_trend(spark, sf_dir):
    return trends.hashtag_trend(_geo_trend(spark, sf_dir), KEYWORDS)


@query
def hashtag_trend_all(spark, sf_dir):
    return trends.hashtag_trend(_geo_trend(spark, sf_dir))


@query
def hashtag_legend(spark, sf_dir):
    return trends.hashtag_legend(_geo_trend(spark, sf_dir))


@query
def trend_json(spark, sf_dir):
    trend = trends.hashtag_trend(_geo_trend(spark, sf_dir), KEYWORDS)
    return lookups.to_result_json(trend, "hashtag", "timebucket", "lat", "lng", "colour")


@query
def keyword_status(spark, sf_dir):
    return lookups.keyword_status(_geo_trend(spark, sf_dir), KEYWORDS)


@query
def lookup_hashtag(spark, sf_dir):
    return lookups.lookup_hashtag(_geo_trend(spark, sf_dir), _table_keywords(spark, sf_dir))


def _table_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = read_nations(spark, sf_dir).select(F.col("n_name").alias("keyword"))
    events = read_events(spark, sf_dir)
    return names.unionByName(events.select(F.upper("event_type").alias("keyword")))


@query
def hashtag_trend_table(spark, sf_dir):
    """Keywords from a table: the different kinds of events."""
    events = read_events(spark, sf_dir)
    wanted = events.select(F.upper("event_type").alias("keyword"))
    return trends.hashtag_trend(_geo_trend(spark, sf_dir), wanted)


@query
def keyword_status_table(spark, sf_dir):
    """Keywords from a table: names of nations, which nobody tags, and kinds of events."""
    return lookups.keyword_status(_geo_trend(spark, sf_dir), _table_keywords(spark, sf_dir))


@query
def trend_map(spark, sf_dir):
    live = jobs.stream_live(event_posts(spark, sf_dir))
    return trends.live_trend(_geo_trend(spark, sf_dir), live, KEYWORDS)


@query
def put_geo(spark, sf_dir):
    """The first half of the posts is stored, then all of them are put: old keys stay as they are."""
    uses = _geo_uses(spark, sf_dir)
    path = shared_dir(spark, "put-geo")
    for part in (uses.where(F.col("created_at") < F.lit(FIRST_HALF_ENDS)), uses, uses):
        tables.put_geo_table(geo.hashtag_geo_latest(part, "1 day"), path)
    return tables.read_served_geo(spark, path)


def _halves(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Points by day of the first half of the time, and of all of it; days of the first half have other points there."""
    uses = _geo_uses(spark, sf_dir)
    early = uses.where(F.col("created_at") < F.lit(FIRST_HALF_ENDS))
    return geo.hashtag_geo_latest(early, "1 day"), geo.hashtag_geo_latest(uses, "1 day")


@query
def put_geo_two_writers(spark, sf_dir):
    """Two writers see an empty table and both store all keys of the first half; the first to enter is first."""
    early, everything = _halves(spark, sf_dir)
    table = tables.served_geo(spark, shared_dir(spark, "two-writers"))
    second = table.prepare(lookups.one_per_key(everything), "stream-0")
    first = table.prepare(lookups.one_per_key(early), "backfill-0")
    again = table.prepare(lookups.one_per_key(early), "backfill-0")
    for pending in (first, second, again):
        pending.publish()
    return table.read()


@query
def put_geo_compacted(spark, sf_dir):
    """Puts before, during and after a compaction of the days."""
    early, everything = _halves(spark, sf_dir)
    points = [lookups.one_per_key(early.where(F.pmod("timebucket", F.lit(3 * 86400)) == n * 86400)) for n in range(3)]
    table = tables.served_geo(spark, shared_dir(spark, "compacted"))
    for rows in (points[0], points[1], points[0]):
        table.commit(rows)
    fold = table.prepare_fold()
    table.commit(points[2])
    table.commit(lookups.one_per_key(everything))
    fold.publish()
    table.commit(lookups.one_per_key(early))
    table.compact()
    table.commit(points[1])
    return table.read()


# Influencers


@query
def retweet_counts(spark, sf_dir):
    return influence.retweet_counts(_reshares(spark, sf_dir), COUNT_BUCKET)


@query
def running_influencers(spark, sf_dir):
    return _totals(spark, sf_dir)


@query
def distinct_retweeters(spark, sf_dir):
    return influence.distinct_resharers(_reshares(spark, sf_dir))


@query
def top_influencers(spark, sf_dir):
    return influence.top_influencers(_totals(spark, sf_dir))


@query
def trend_influencers(spark, sf_dir):
    totals = _totals(spark, sf_dir)
    return influencer_plans.trend_influencers(totals, event_profiles(spark, sf_dir))


@query
def trend_influencers_keywords(spark, sf_dir):
    totals = _totals(spark, sf_dir)
    return influencer_plans.trend_influencers(totals, event_profiles(spark, sf_dir), KEYWORDS)


@query
def lookup_hashtag_user(spark, sf_dir):
    """Totals of the pairs that were seen in the second half of the time."""
    later = _reshares(spark, sf_dir).where(F.col("created_at") >= F.lit(FIRST_HALF_ENDS))
    return lookups.lookup_hashtag_user(
        _totals(spark, sf_dir), later.select("hashtag", "user_handle")
    )


@query
def accumulate_counts(spark, sf_dir):
    """Totals of the first half of the time, plus the counts of the second."""
    uses = _reshares(spark, sf_dir)
    early = F.col("created_at") < F.lit(FIRST_HALF_ENDS)
    stored = influence.running_influencers(uses.where(early))
    batch = influence.retweet_counts(uses.where(~early), COUNT_BUCKET)
    return influence.accumulate_counts(stored, batch)


@query
def count_batches(spark, sf_dir):
    """The same through stored batches, the second of which is written twice."""
    uses = _reshares(spark, sf_dir)
    path = shared_dir(spark, "counts")
    early = F.col("created_at") < F.lit(FIRST_HALF_ENDS)
    for batch_id, part in ((0, early), (1, ~early), (1, ~early)):
        counts = influence.retweet_counts(uses.where(part), "1 day")
        tables.write_count_batch(counts, batch_id, path)
    return tables.read_counts(spark, path)


# Users


@query
def timeline(spark, sf_dir):
    posts = users.user_posts(event_posts(spark, sf_dir))
    return users.timeline(posts, page_size=10).select("user_handle", "id", "rn", "page")


@query
def timeline_pages(spark, sf_dir):
    """The same page by page, each from where the one before ended."""
    path = shared_dir(spark, "user-posts")
    users.write_user_posts(users.user_posts(event_posts(spark, sf_dir)), path)
    table, last, pages = spark.read.parquet(path), None, []
    for page in (1, 2, 3):
        found = stored(users.next_page(table, last, 10).select("user_handle", "id", "place"), "page")
        last = found.groupBy("user_handle").agg(F.min("id").alias("last_id"))
        pages.append(found.select("user_handle", "id", (F.col("place") + 10 * (page - 1)).alias("rn"), F.lit(page).alias("page")))
    return pages[0].unionByName(pages[1]).unionByName(pages[2])


@query
def user_avg_retweets(spark, sf_dir):
    return users.user_avg_retweets(_timeline(spark, sf_dir))


def _register_user_lists() -> None:
    lists = {
        "user_hashtags": users.user_hashtags,
        "user_mentions": users.user_mentions,
        "user_replies": users.user_replies,
        "user_locations": users.user_locations,
    }
    for name, count in lists.items():
        for n in (15, 3):

            def build(spark, sf_dir, count=count, n=n):
                return users.top_n(count(_timeline(spark, sf_dir)), n)

            build.__name__ = name if n == 15 else f"{name}_top{n}"
            query(build)


_register_user_lists()


@query
def user_item_counts(spark, sf_dir):
    return users.item_counts(_timeline(spark, sf_dir))


@query
def user_shares(spark, sf_dir):
    return users.with_shares(users.top_n(users.item_counts(_timeline(spark, sf_dir))))


@query
def user_page(spark, sf_dir):
    return user_plans.user_page(event_posts(spark, sf_dir), event_profiles(spark, sf_dir))


@query
def user_page_handles(spark, sf_dir):
    posts, known = event_posts(spark, sf_dir), event_profiles(spark, sf_dir)
    return user_plans.user_page(posts, known, HANDLES)


# Streams, run over all there is and read back


@query
def stream_geo(spark, sf_dir):
    path = shared_dir(spark, "stream-geo")
    posts = stream_event_posts(spark, sf_dir)
    sinks.accumulate_geo(posts, f"{path}/table", f"{path}/checkpoint", GEO_BUCKET, None).awaitTermination()
    return tables.read_newest(spark, f"{path}/table")


@query
def stream_influencers(spark, sf_dir):
    path = shared_dir(spark, "stream-influencers")
    posts = stream_event_posts(spark, sf_dir)
    sinks.accumulate_intervals(posts, f"{path}/table", f"{path}/checkpoint", COUNT_BUCKET, None).awaitTermination()
    return tables.read_interval_counts(spark, f"{path}/table")


@query
def stream_put_geo(spark, sf_dir):
    """The first half of the posts is put as a backfill, then all of them as a stream into the same table."""
    path = shared_dir(spark, "stream-put")
    early = _geo_uses(spark, sf_dir).where(F.col("created_at") < F.lit(FIRST_HALF_ENDS))
    tables.put_geo_table(geo.hashtag_geo_latest(early, "1 day"), f"{path}/table")
    posts = stream_event_posts(spark, sf_dir)
    sinks.put_points(posts, f"{path}/table", f"{path}/checkpoint", "1 day", None).awaitTermination()
    return tables.read_served_geo(spark, f"{path}/table")


@query
def stream_put_once(spark, sf_dir):
    """The geo trend delivered twice as a stream: each key passes once."""
    use_rocksdb_state(spark)
    path = shared_dir(spark, "put-once")
    trend = _geo_trend(spark, sf_dir).withColumn("at", F.timestamp_seconds("timebucket"))
    for _ in range(2):
        trend.write.mode("append").parquet(f"{path}/in")
    stream = jobs.put_once(spark.readStream.schema(trend.schema).parquet(f"{path}/in"), "at", DELAY)
    sinks.write_batches(stream, f"{path}/table", f"{path}/checkpoint", every=None).awaitTermination()
    return tables.read_geo_table(spark, f"{path}/table")


@query
def stream_trend_map(spark, sf_dir):
    """The map with its live side from a stream."""
    path = shared_dir(spark, "stream-map")
    markers = trends.live_markers(jobs.stream_live(stream_event_posts(spark, sf_dir)), KEYWORDS)
    sinks.write_batches(markers, f"{path}/table", f"{path}/checkpoint", every=None).awaitTermination()
    stored = spark.read.schema(markers.schema).parquet(f"{path}/table")
    return trends.trend_map(_geo_trend(spark, sf_dir), stored, KEYWORDS)


@query
def stream_running(spark, sf_dir):
    use_rocksdb_state(spark)
    path = shared_dir(spark, "stream-running")
    totals = jobs.stream_running(stream_event_posts(spark, sf_dir))
    sinks.write_totals(totals, f"{path}/table", f"{path}/checkpoint", every=None).awaitTermination()
    return tables.read_totals(spark, f"{path}/table")


@query
def stream_accumulate(spark, sf_dir):
    path = shared_dir(spark, "stream-accumulate")
    posts = stream_event_posts(spark, sf_dir)
    sinks.accumulate_counts(posts, f"{path}/table", f"{path}/checkpoint", every=None).awaitTermination()
    tables.compact_counts(spark, f"{path}/table")
    return tables.read_counts(spark, f"{path}/table")


@query
def stream_compact_continue(spark, sf_dir):
    """The first half is streamed, the table compacted, and a stream with a new checkpoint adds the rest."""
    path = shared_dir(spark, "stream-continue")
    posts = stream_event_posts(spark, sf_dir)
    early = F.col("created_at") < F.lit(FIRST_HALF_ENDS)
    for run, part in (("first", early), ("second", ~early)):
        checkpoint = f"{path}/checkpoint-{run}"
        sinks.accumulate_counts(posts.where(part), f"{path}/table", checkpoint, every=None).awaitTermination()
        tables.compact_counts(spark, f"{path}/table")
    return tables.read_counts(spark, f"{path}/table")


@query
def stream_live(spark, sf_dir):
    path = shared_dir(spark, "stream-live")
    points = jobs.stream_live(stream_event_posts(spark, sf_dir))
    sinks.write_batches(points, f"{path}/table", f"{path}/checkpoint", every=None).awaitTermination()
    return spark.read.parquet(f"{path}/table")


@query
def stream_live_messages(spark, sf_dir):
    path = shared_dir(spark, "live-messages")
    points = jobs.stream_live(stream_event_posts(spark, sf_dir), "CLICK")
    sent = sinks.publish_live(points, "parquet", f"{path}/checkpoint", path=f"{path}/table")
    sent.awaitTermination()
    return spark.read.parquet(f"{path}/table")


# The same over many batches: events arrive in slices of time, neighbours swapped, with a restart in the middle

ARRIVALS = [n ^ 1 for n in range(REPLAY_SLICES)]
REPLAY_DELAY = "6 days"
LATE_ARRIVALS = [*range(1, REPLAY_SLICES), 0]


def _replayed(spark: SparkSession, sf_dir: str, start, arrivals: list[int] = ARRIVALS, close: bool = False) -> str:
    """Run a stream over half of the arrivals, and again, from its checkpoint, over the other half."""
    path, half = shared_dir(spark, "replay"), len(arrivals) // 2
    events = read_events(spark, sf_dir)
    for part in (arrivals[:half], arrivals[half:]):
        write_arrivals(events, f"{path}/in", part)
        if close and part == arrivals[half:]:
            closing_event(events, "30 days").write.mode("append").parquet(f"{path}/in")
        posts = stream_event_posts(spark, sf_dir, 1, f"{path}/in")
        start(posts, f"{path}/table", f"{path}/checkpoint").awaitTermination()
    return f"{path}/table"


@query
def stream_geo_window(spark, sf_dir):
    """The geo trend by watermark, all of it, as an event beyond the delay closes the last intervals."""

    def start(posts, path, checkpoint):
        return sinks.write_batches(jobs.stream_geo(posts, GEO_BUCKET, REPLAY_DELAY), path, checkpoint, every=None)

    return tables.read_geo_table(spark, _replayed(spark, sf_dir, start, close=True))


def _windowed_counts(spark: SparkSession, sf_dir: str, delay: str, arrivals: list[int]) -> DataFrame:
    def start(posts, path, checkpoint):
        return sinks.write_batches(jobs.stream_influencers(posts, COUNT_BUCKET, delay), path, checkpoint, every=None)

    path = _replayed(spark, sf_dir, start, arrivals, close=True)
    return spark.read.schema(tables.INTERVAL_COUNTS).parquet(path).select("hashtag", "user_handle", "timebucket", "count")


@query
def stream_influencers_window(spark, sf_dir):
    return _windowed_counts(spark, sf_dir, REPLAY_DELAY, ARRIVALS)


@query
def stream_influencers_late(spark, sf_dir):
    """The first slice comes last, when the watermark is far beyond it: its posts are left out."""
    return _windowed_counts(spark, sf_dir, DELAY, LATE_ARRIVALS)


@query
def stream_replay_counts(spark, sf_dir):
    """Counts of many batches, late ones and a restart among them."""

    def start(posts, path, checkpoint):
        return sinks.accumulate_counts(posts, path, checkpoint, every=None)

    return tables.read_counts(spark, _replayed(spark, sf_dir, start, LATE_ARRIVALS))


@query
def stream_replay_running(spark, sf_dir):
    use_rocksdb_state(spark)

    def start(posts, path, checkpoint):
        return sinks.write_totals(jobs.stream_running(posts), path, checkpoint, every=None)

    return tables.read_totals(spark, _replayed(spark, sf_dir, start))


@query
def stream_replay_put(spark, sf_dir):
    """Points put batch by batch: of a key that comes in several, the first to arrive stays."""

    def start(posts, path, checkpoint):
        return sinks.put_points(posts, path, checkpoint, "1 day", None)

    return tables.read_served_geo(spark, _replayed(spark, sf_dir, start))


@query
def stream_people(spark, sf_dir):
    """Whether the people counted by sketches, united over many batches, are as many as stated, by key."""

    def start(posts, path, checkpoint):
        return sinks.accumulate_people(posts, path, checkpoint, every=None)

    found = influence.sketched_resharers(tables.read_people(spark, _replayed(spark, sf_dir, start)))
    exact = influence.distinct_resharers(_reshares(spark, sf_dir)).withColumnRenamed("people", "exact")
    close = F.abs(F.col("people") - F.col("exact")) <= influence.SKETCH_ERROR * F.col("exact")
    return exact.join(found, ["hashtag", "user_handle"], "left").select(
        "hashtag", "user_handle", F.coalesce(close, F.lit(False)).alias("within")
    )


# Old dumps, written from the posts and read again


@query
def backfill_geo(spark, sf_dir):
    path = shared_dir(spark, "geo-dump")
    dumps.dump_geo(geo.hashtag_points(_geo_uses(spark, sf_dir), "1 day", parts=8), path)
    return dumps.backfill_geo(spark, path).withColumn("ts", _seconds("ts"))


@query
def backfill_geo_latest(spark, sf_dir):
    path = shared_dir(spark, "geo-dump")
    dumps.dump_geo(geo.hashtag_points(_geo_uses(spark, sf_dir), "1 day", parts=8), path)
    return geo.latest_dumped_points(dumps.backfill_geo(spark, path))


@query
def backfill_influencers(spark, sf_dir):
    path = shared_dir(spark, "count-dump")
    dumps.dump_influencers(influence.retweet_counts(_reshares(spark, sf_dir), "1 day"), path)
    return dumps.backfill_influencers(spark, path)
