import pytest

from conftest import at, author, entities, message, place, reshare_of, rows
from hashwave.operators import geo, influence
from hashwave.plans import trends
from hashwave.sources.tables import put_geo_table, read_counts, read_interval_counts, read_newest, read_served_geo, read_totals, stored_rows
from hashwave.sources.tweets import read_tweets, stream_tweets
from hashwave.streaming import jobs, sinks

START = 1428350400


def minute(m, second=0):
    return at(f"20:{m:02d}:{second:02d}")


def posts_of(minutes, first_id=0):
    return [
        message(
            first_id + n,
            f"#T{n % 3} #all",
            created_at=minute(m),
            place=place(float(n), float(m)),
            user=author(f"u{n % 4}"),
            entities=entities([f"E{n % 2}"]),
            retweeted_status=reshare_of(f"o{n % 2}") if n % 2 else None,
        )
        for n, m in enumerate(minutes)
    ]


@pytest.fixture
def folders(tmp_path):
    return str(tmp_path / "out"), str(tmp_path / "checkpoint")


def run(rows_df, folders):
    sinks.write_batches(rows_df, *folders, every=None).awaitTermination()


def test_finished_intervals_equal_the_batch_result(spark, write_messages, folders):
    path = write_messages(posts_of(range(0, 10)))
    for part in (range(10, 25), range(25, 59)):
        write_messages(posts_of(part, part[0]), path)
    stream = stream_tweets(spark, path, max_files=1)
    run(jobs.stream_geo(stream, "5 minutes", "2 minutes"), folders)
    batch = geo.hashtag_geo_latest(geo.geo_uses(read_tweets(spark, path)), "5 minutes")
    finished = batch.where(f"timebucket <= {START + 58 * 60 - 120}")
    assert rows(spark.read.parquet(folders[0]).drop("date")) == rows(finished)


def test_accumulated_intervals_lose_nothing_out_of_time_order(spark, write_messages, folders):
    path = write_messages(posts_of(range(40, 59), 40))
    write_messages(posts_of(range(0, 20)), path)
    stream = stream_tweets(spark, path, max_files=1)
    sinks.accumulate_geo(stream, f"{folders[0]}/geo", f"{folders[1]}/geo", "5 minutes", None).awaitTermination()
    sinks.accumulate_intervals(stream, f"{folders[0]}/n", f"{folders[1]}/n", "15 minutes", None).awaitTermination()
    posts = read_tweets(spark, path)
    assert rows(read_newest(spark, f"{folders[0]}/geo")) == rows(geo.hashtag_geo_latest(geo.geo_uses(posts), "5 minutes"))
    names = ["hashtag", "user_handle", "timebucket", "count"]
    counts = influence.retweet_counts(influence.reshare_uses(posts), "15 minutes")
    assert rows(read_interval_counts(spark, f"{folders[0]}/n"), *names) == rows(counts, *names)


def test_a_stream_puts_no_key_twice(spark, write_messages, folders):
    path = write_messages(posts_of(range(0, 9)))
    put_geo_table(geo.hashtag_geo_latest(geo.geo_uses(read_tweets(spark, path)), "1 minute"), folders[0])
    before = rows(read_served_geo(spark, folders[0]))
    write_messages(posts_of([5, 30], 100), path)
    sinks.put_points(stream_tweets(spark, path), *folders, "1 minute", None).awaitTermination()
    after = rows(read_served_geo(spark, folders[0]))
    assert set(before) < set(after) and len({r[:2] for r in after}) == len(after)


def test_live_markers_of_a_stream(spark, write_messages, folders):
    path = write_messages(posts_of(range(0, 8)))
    words = spark.createDataFrame([("E1",)], "keyword string")
    posts = read_tweets(spark, path)
    for n, wanted in enumerate((["E1"], words)):
        markers = trends.live_markers(jobs.stream_live(stream_tweets(spark, path)), wanted)
        run(markers, [f"{f}/{n}" for f in folders])
        table = geo.hashtag_geo_latest(geo.geo_uses(posts), "1 minute")
        shown = trends.trend_map(table, spark.read.parquet(f"{folders[0]}/{n}"), wanted)
        expected = trends.live_trend(table, jobs.stream_live(posts), wanted)
        assert rows(shown) == rows(expected) and shown.count() == 4


def test_influencer_intervals_equal_the_batch_result(spark, write_messages, folders):
    path = write_messages(posts_of(range(0, 59)))
    run(jobs.stream_influencers(stream_tweets(spark, path)), folders)
    batch = influence.retweet_counts(influence.reshare_uses(read_tweets(spark, path)), "15 minutes")
    names = ["hashtag", "user_handle", "timebucket", "count"]
    finished = batch.where(f"timebucket <= {START + 57 * 60 - 900}")
    assert rows(spark.read.parquet(folders[0]), *names) == rows(finished, *names)


def test_late_posts_are_left_out_of_finished_intervals(spark, write_messages, folders):
    path = write_messages(posts_of([0, 10, 20, 40]))
    stream = lambda: jobs.stream_influencers(stream_tweets(spark, path), "5 minutes", "5 minutes")
    run(stream(), folders)
    write_messages(posts_of([1, 1, 50, 50], 100), path)
    run(stream(), folders)
    ends = {r.timebucket for r in spark.read.parquet(folders[0]).collect()}
    assert START + 15 * 60 in ends and START + 5 * 60 not in ends


def test_running_totals_equal_the_batch_result_and_survive_a_restart(spark, write_messages, folders):
    path = write_messages(posts_of(range(0, 20)))
    for later in (None, posts_of(range(20, 40), 20), posts_of([0, 1, 2], 900)):
        if later:
            write_messages(later, path)
        totals = jobs.stream_running(stream_tweets(spark, path))
        sinks.write_totals(totals, *folders, every=None).awaitTermination()
        batch = influence.running_influencers(influence.reshare_uses(read_tweets(spark, path)))
        assert rows(read_totals(spark, folders[0])) == rows(batch)


def test_accumulated_batches_count_late_and_early_posts_once(spark, write_messages, folders):
    path = write_messages(posts_of(range(0, 20)))
    for later in (None, posts_of([0, 1, 50], 900)):
        if later:
            write_messages(later, path)
        posts = stream_tweets(spark, path, max_files=1)
        sinks.accumulate_counts(posts, *folders, every=None).awaitTermination()
        batch = influence.running_influencers(influence.reshare_uses(read_tweets(spark, path)))
        assert rows(read_counts(spark, folders[0])) == rows(batch)


def test_stored_rows_are_merged_and_compacted_by_day(spark, write_messages, folders):
    path = write_messages(posts_of(range(0, 3)))
    for n in range(1, 20):
        write_messages(posts_of([n], 100 * n), path)
    trend = lambda posts: geo.point_rows(geo.geo_uses(posts), "1 minute")
    sinks.store_rows(trend(stream_tweets(spark, path, max_files=1)), *folders, ["hashtag", "timebucket"], None).awaitTermination()
    expected = trend(read_tweets(spark, path))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in expected.schema)
    table = stored_rows(spark, folders[0], schema, ["hashtag", "timebucket"])
    assert len(table.log.state().pieces["2015-04-06"]) < 10
    assert rows(table.read(), *expected.columns) == rows(expected)
    assert table.compact(["2015-04-06"]) and len(table.read().inputFiles()) == 1
    assert rows(table.read(["2015-04-06"]), *expected.columns) == rows(expected) and table.read(["2015-04-07"]).count() == 0


def test_running_totals_in_complete_mode(spark, write_messages):
    path = write_messages(posts_of(range(0, 20)))
    totals = jobs.stream_running(stream_tweets(spark, path))
    query = totals.writeStream.format("memory").queryName("totals").outputMode("complete")
    query.trigger(availableNow=True).start().awaitTermination()
    batch = influence.running_influencers(influence.reshare_uses(read_tweets(spark, path)))
    assert rows(spark.table("totals")) == rows(batch)


def test_live_points_of_a_hashtag(spark, write_messages, folders):
    path = write_messages(posts_of(range(0, 8)))
    run(jobs.stream_live(stream_tweets(spark, path), "E1"), folders)
    found = spark.read.parquet(folders[0])
    expected = geo.live_points(read_tweets(spark, path)).where("hashtag = 'e1'")
    assert rows(found, "id", "lat", "lng") == rows(expected, "id", "lat", "lng")


def test_live_messages(spark, write_messages, folders):
    path = write_messages(posts_of([3]))
    points = jobs.stream_live(stream_tweets(spark, path))
    sinks.publish_live(points, "json", folders[1], path=folders[0]).awaitTermination()
    assert rows(spark.read.json(folders[0])) == [("e0", '{"lat":3.0,"lng":0.0}')]


def test_replayed_rows_pass_once(spark, tmp_path, folders):
    source = str(tmp_path / "in")
    replay = spark.sql(
        "select 'a' as hashtag, 5L as timebucket, timestamp '2015-04-06 20:00:00' as ts "
        "union all select 'b', 5L, timestamp '2015-04-06 20:00:00'"
    ).coalesce(1)
    for _ in range(3):
        replay.write.mode("append").parquet(source)
    stream = spark.readStream.schema(replay.schema).option("maxFilesPerTrigger", 1).parquet(source)
    run(jobs.put_once(stream, "ts", "1 hour"), folders)
    assert rows(spark.read.parquet(folders[0]), "hashtag", "timebucket") == [("a", 5), ("b", 5)]


def test_polling_keeps_running(spark, write_messages, folders):
    path = write_messages(posts_of([0]))
    live = jobs.stream_live(stream_tweets(spark, path))
    query = sinks.write_batches(live, *folders, every="1 second")
    try:
        query.processAllAvailable()
        write_messages(posts_of([1], 1), path)
        query.processAllAvailable()
        assert query.isActive
    finally:
        query.stop()
    assert rows(spark.read.parquet(folders[0]), "id") == [(0,), (1,)]
