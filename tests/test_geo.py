from collections import Counter

import pytest
from pyspark.sql import functions as F

from conftest import at, entities, message, place, point, rows
from hashwave.operators import filters, geo, lookups
from hashwave.plans import trends

START = 1428350400  # 2015-04-06 20:00:00


def trend(spark, *items):
    return spark.createDataFrame(list(items), "hashtag string, timebucket bigint, lat double, lng double")


def test_posts_without_any_point_have_no_geography(tweets):
    posts = tweets(message(1, "#a", entities=entities(["a"])))
    assert geo.geo_uses(posts).count() == 0
    assert geo.live_points(posts).count() == 0


def test_geo_uses_the_corner_and_live_uses_the_exact_point(tweets):
    posts = tweets(
        message(1, "#T", place=place(3.0, 4.0), coordinates=point(1.0, 2.0), entities=entities(["E"])),
        message(2, "#U", place=place(5.0, 6.0), entities=entities(["F"])),
        message(3, "#V", coordinates=point(7.0, 8.0), entities=entities(["G"])),
    )
    assert rows(geo.geo_uses(posts), "hashtag", "lat", "lng") == [("T", 4.0, 3.0), ("U", 6.0, 5.0)]
    assert rows(geo.live_points(posts), "hashtag", "lat", "lng") == [
        ("e", 2.0, 1.0), ("f", 6.0, 5.0), ("g", 8.0, 7.0)
    ]


def test_place_without_a_box_has_no_point(tweets):
    posts = tweets(message(1, "#a", place={"full_name": "X", "bounding_box": None}))
    assert geo.geo_uses(posts).count() == 0


def test_last_point_wins_whatever_the_case(tweets):
    posts = tweets(
        message(1, "#Foo", created_at=at("20:00:01"), place=place(1.0, 1.0)),
        message(3, "#foo", created_at=at("20:00:05"), place=place(3.0, 3.0)),
        message(2, "#FOO", created_at=at("20:00:05"), place=place(2.0, 2.0)),
        message(4, "#foo", created_at=at("20:15:00"), place=place(4.0, 4.0)),
    )
    latest = geo.hashtag_geo_latest(geo.geo_uses(posts), "15 minutes")
    assert rows(latest) == [("foo", START + 900, 3.0, 3.0), ("foo", START + 1800, 4.0, 4.0)]


def test_last_point_among_very_large_ids(tweets):
    top = 2**63 - 1
    posts = tweets(
        message(top - 1, "#a", created_at=at("20:00:01"), place=place(1.0, 1.0)),
        message(top, "#a", created_at=at("20:00:01"), place=place(2.0, 2.0)),
        message(top - 2, "#a", created_at=at("20:00:01"), place=place(3.0, 3.0)),
        message(5, "#b", created_at=at("20:00:02"), place=place(4.0, 4.0)),
        message(top, "#b", created_at=at("20:00:01"), place=place(5.0, 5.0)),
    )
    latest = geo.hashtag_geo_latest(geo.geo_uses(posts), "1 minute")
    assert rows(latest, "hashtag", "lat", "lng") == [("a", 2.0, 2.0), ("b", 4.0, 4.0)]


def test_latest_point_is_hashed_and_combined_before_the_shuffle(tweets):
    posts = tweets(message(1, "#a", place=place(1.0, 1.0)))
    plan = geo.hashtag_geo_latest(geo.geo_uses(posts), "1 minute")._jdf.queryExecution()
    text = plan.executedPlan().toString()
    assert "partial_max_by" in text and "SortAggregate" not in text
    assert text.count("Exchange hashpartitioning") == 1


@pytest.mark.parametrize("parts", [1, 4, 7])
def test_groups_are_split_and_stay_whole(spark, parts):
    """One hashtag holds most of the points."""
    uses = spark.range(400).selectExpr(
        "id",
        "timestamp_seconds(1428350400 + id % 50) AS created_at",
        "0 AS pos",
        "CASE WHEN id % 3 = 0 THEN 'h' || id ELSE 'hot' END AS hashtag",
        "double(id) AS lat",
        "double(-id) AS lng",
    )
    groups = geo.hashtag_points(uses, "1 hour", parts).collect()
    spread = Counter(p.lat for g in groups for p in g.points)
    assert spread == Counter(float(i) for i in range(400))
    assert all(g.uses == len(g.points) and g.points == sorted(g.points) for g in groups)
    hot = [g for g in groups if g.hashtag == "hot"]
    assert len({g.part for g in hot}) == len(hot) == parts
    assert max(g.uses for g in hot) - min(g.uses for g in hot) <= parts


def test_incomplete_rows_are_not_stored(spark):
    df = trend(spark, ("a", 1, 0.0, 0.0), ("", 1, 1.0, 1.0), ("b", 0, 1.0, 1.0), ("c", 1, None, 1.0))
    assert rows(filters.complete_rows(df)) == [("a", 1, 0.0, 0.0)]


def test_box_filter(tweets):
    posts = tweets(
        message(1, place=place(10.0, 20.0), entities=entities(["in"])),
        message(2, place=place(50.0, 20.0), entities=entities(["out"])),
    )
    inside = filters.bbox_filter(geo.live_points(posts), 0, 0, 40, 40)
    assert rows(inside, "hashtag") == [("in",)]


def test_trend_for_keywords_from_list_and_table(spark):
    table = trend(spark, ("a", 0, 1.0, 1.0), ("a", 50, 2.0, 2.0), ("a", 100, 3.0, 3.0), ("b", 7, 4.0, 4.0))
    words = spark.createDataFrame([("A",), ("A",), ("zzz",)], "keyword string")
    expected = [("a", 0, 1), ("a", 100, None), ("a", 50, 3)]
    for keywords in (["A", "zzz"], words):
        assert rows(trends.hashtag_trend(table, keywords), "hashtag", "timebucket", "slice") == expected
        assert trends.hashtag_legend(table, keywords).count() == 6


def test_points_carry_the_legend_of_their_slice(spark):
    table = trend(spark, ("a", 0, 1.0, 1.5), ("a", 7000, 3.0, 3.0))
    first = trends.hashtag_trend(table).orderBy("timebucket").first()
    assert first.label == "0 sec - 23 minute(s)"
    assert (first.colour, first.icon) == ("#43C6DB", "43C6DB.gif")
    assert first.point == '{"timebucket":0,"lat":1.0,"lng":1.5}'


def test_map_shows_recorded_and_live_points(spark):
    table = trend(spark, ("a", 0, 1.0, 1.0), ("a", 10, 2.0, 2.0), ("b", 0, 9.0, 9.0))
    live = spark.createDataFrame([("a", 5.0, 6.0), ("c", 7.0, 8.0)], "hashtag string, lat double, lng double")
    shown = trends.live_trend(table, live, ["a"])
    assert rows(shown, "lat", "slice", "colour") == [
        (1.0, 1, "#43C6DB"), (2.0, None, None), (5.0, 6, "#000000")
    ]


def test_keyword_status(spark):
    table = trend(spark, ("a", 0, 1.0, 1.0), ("a", 1, 1.0, 1.0), ("b", 0, 1.0, 1.0))
    words = spark.createDataFrame([("A",), ("none",)], "keyword string")
    for keywords in (["A", "none"], words):
        assert rows(lookups.keyword_status(table, keywords)) == [("a", 2, True), ("none", 0, False)]


def test_ordered_scan_and_range(spark):
    table = trend(spark, ("a", 30, 1.0, 1.0), ("a", 10, 2.0, 2.0), ("a", 20, 3.0, 3.0))
    assert [r.timebucket for r in geo.ordered_by_time(table).collect()] == [10, 20, 30]
    assert rows(geo.hashtag_time_range(table)) == [("a", 10, 30)]


def test_put_keeps_stored_rows(spark):
    stored = trend(spark, ("a", 1, 1.0, 1.0))
    batch = trend(spark, ("a", 1, 9.0, 9.0), ("a", 2, 2.0, 2.0), ("a", 2, 3.0, 0.0))
    for order, point in ((-F.col("lat"), (2.0, 2.0)), (F.col("lat"), (3.0, 0.0))):
        assert rows(lookups.put_geo(stored, batch, order)) == [("a", 2, *point)]
    assert rows(lookups.put_geo(stored, batch)) in ([("a", 2, 2.0, 2.0)], [("a", 2, 3.0, 0.0)])


def test_result_json_keeps_nulls(spark):
    df = spark.createDataFrame([("a", None)], "hashtag string, lat double")
    assert lookups.to_result_json(df).first()[0] == '{"hashtag":"a","lat":null}'


def test_hashtag_filter_reaches_the_scan(spark, tmp_path):
    trend(spark, ("a", 1, 1.0, 1.0)).write.parquet(str(tmp_path / "t"))
    table = spark.read.parquet(str(tmp_path / "t"))
    plan = trends.hashtag_trend(table, ["A"])._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(hashtag), EqualTo(hashtag,a)]" in plan or "In(hashtag" in plan


@pytest.fixture
def small_partitions(spark):
    """Thresholds at which the skew handling shows on test data."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "10KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "10KB",
        "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1KB",
    }
    before = {name: spark.conf.get(name, None) for name in settings}
    for name, value in settings.items():
        spark.conf.set(name, value)
    yield
    for name, value in before.items():
        spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def final_plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def hot_uses(spark, n=60000):
    return spark.range(0, n, 1, 8).selectExpr(
        "CASE WHEN id % 3 = 0 THEN 'h' || id % 1000 ELSE 'hot' END AS hashtag",
        "id AS timebucket",
        "id",
        "0 AS pos",
        "timestamp_seconds(id % 3000) AS created_at",
        "rand(1) AS lat",
        "rand(2) AS lng",
    )


def test_hot_hashtag_is_split_in_the_range_join(spark, small_partitions):
    table = hot_uses(spark).select("hashtag", "timebucket", "lat", "lng")
    sliced = geo.hashtag_slices(table)
    assert sliced.count() == 60000
    assert "skew=true" in final_plan(sliced)


def test_hot_group_of_points_is_split(spark):
    groups = geo.hashtag_points(hot_uses(spark), "1 hour", 16)
    plan = groups._jdf.queryExecution().executedPlan().toString()
    found = groups.collect()
    assert sum(r.uses for r in found) == 60000
    hot = [r.uses for r in found if r.hashtag == "hot"]
    assert len(hot) >= 16 and max(hot) < sum(hot) / 8
    assert plan.count("Exchange hashpartitioning") == 1


def test_hot_hashtag_is_split_in_the_keyword_join(spark, small_partitions):
    words = spark.range(200).selectExpr("'H' || id AS keyword").union(spark.sql("select 'HOT'"))
    found = lookups.lookup_hashtag(hot_uses(spark), words)
    assert "skew=true" in final_plan(found)
