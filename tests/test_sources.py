import json
import re
from datetime import date
from decimal import Decimal

from pyspark.sql import functions as F

from conftest import entities, message, rows
from hashwave.operators import geo, influence, lookups, users
from hashwave.schemas import GEO_TREND
from hashwave.sources import dumps, tables
from hashwave.sources.tweets import decode_tweets, read_profiles, read_tweets

START = 1428350400


def batch_file(root, folder, text, name="part-00000"):
    (root / folder).mkdir(parents=True, exist_ok=True)
    (root / folder / name).write_text(text)


def test_control_messages_are_skipped(spark, write_messages):
    path = write_messages([{"delete": {"status": {"id": 1}}}, message(2, "x"), {"limit": {"track": 3}}])
    found = read_tweets(spark, path)
    assert rows(found, "id") == [(2,)]
    assert found.select(F.unix_seconds("created_at")).first()[0] == START


def test_posts_round_trip_through_parquet(spark, tweets, tmp_path):
    posts = tweets(message(1, "#a", entities=entities(["a"])), message(2))
    posts.write.parquet(str(tmp_path / "p"))
    again = read_tweets(spark, str(tmp_path / "p"), "parquet")
    assert again.schema.simpleString() == posts.schema.simpleString()
    assert rows(again, "id", "text") == rows(posts, "id", "text")


def test_posts_from_message_values(spark):
    values = [json.dumps(message(7, "hey")), json.dumps({"delete": {}}), "not json"]
    queue = spark.createDataFrame([(v.encode(),) for v in values], "value binary")
    assert rows(decode_tweets(queue), "id", "text") == [(7, "hey")]


def test_profiles(spark, tmp_path):
    path = str(tmp_path / "profiles")
    spark.sql("select 'a' as screen_name, 3L as followers_count").write.parquet(path)
    found = read_profiles(spark, path).first()
    assert (found.screen_name, found.followers_count, found.description) == ("a", 3, None)


def test_batch_time_comes_from_the_folder(spark):
    paths = spark.createDataFrame(
        [("s3://b/-1428350400000.geo/part-00001",), ("s3://b/other/part-00001",)], "p string"
    )
    assert [r[0] for r in paths.select(dumps.path_timebucket(F.col("p"))).collect()] == [START, None]


def test_geo_dump(spark, tmp_path):
    record = (
        "(Foo,ArrayBuffer((Mon Apr 06 20:00:00 UTC 2015,1.5,-2.5), (Tue Apr 07 20:00:01 UTC 2016,3.0,4.0)))\n"
        "(a,b,ArrayBuffer((Mon Apr 06 20:00:00 UTC 2015,5.0,6.0)))\n"
        "(x\n#glued,ArrayBuffer((Mon Apr 06 20:00:00 UTC 2015,7.0,8.0)))\n"
        "(nothing,ArrayBuffer())\n"
        "(bad,ArrayBuffer((Mon Apr 06 20:00:00 UTC 2015,seven,8.0)))\n"
    )
    batch_file(tmp_path, "-1428350400000.geo", record)
    batch_file(tmp_path, "-1428350400000.geo", "not empty", name="_SUCCESS")
    batch_file(tmp_path, "-1428350401000.geo", "(foo,ArrayBuffer((Mon Apr 06 20:00:00 UTC 2015,9.0,9.0)))")
    found = dumps.backfill_geo(spark, str(tmp_path)).withColumn("ts", F.unix_seconds("ts"))
    assert rows(found) == [
        ("a,b", START, START, 5.0, 6.0),
        ("foo", START, START, 1.5, -2.5),
        ("foo", START, START + 366 * 86400 + 86401, 3.0, 4.0),
        ("foo", START + 1, START, 9.0, 9.0),
        ("x\n#glued", START, START, 7.0, 8.0),
    ]


def test_count_dump(spark, tmp_path):
    lines = ["((Foo,bob),3)", "((a,b,c),2)", "((a)b,c),2)", "((d,e),x)", "nonsense", "((f,g),-1) "]
    batch_file(tmp_path, "-1428350400000.n", "\n".join(lines))
    batch_file(tmp_path, "-1428350400000.n", "((no,no),1)", name="_SUCCESS")
    assert rows(dumps.backfill_influencers(spark, str(tmp_path)), "hashtag", "user_handle", "count") == [
        ("a", "c", 2), ("f", "g", -1), ("foo", "bob", 3)
    ]


def test_dumps_read_back_what_was_written(spark, tmp_path):
    uses = spark.range(100).selectExpr(
        "id", "timestamp_seconds(1428350400 + id * 60) AS created_at", "0 AS pos",
        "'t' || id % 4 AS hashtag", "id / 7 AS lat", "-id / 3 AS lng",
    )
    dumps.dump_geo(geo.hashtag_points(uses, "1 hour", 5), str(tmp_path / "g"))
    found = dumps.backfill_geo(spark, str(tmp_path / "g"))
    written = geo.point_rows(uses, "1 hour").select("hashtag", "timebucket", "ts", "lat", "lng")
    assert rows(found) == rows(written)


def test_geo_table_keeps_the_first_row_of_a_key(spark, tmp_path):
    path = str(tmp_path / "geo")
    row = lambda *r: spark.createDataFrame([r], "hashtag string, timebucket bigint, lat double, lng double")
    for batch in (row("a", START, 1.0, 1.0), row("a", START, 2.0, 2.0), row("b", START, 3.0, 3.0)):
        tables.put_geo_table(batch, path)
    assert rows(tables.read_served_geo(spark, path)) == [("a", START, 1.0, 1.0), ("b", START, 3.0, 3.0)]
    assert len(list((tmp_path / "geo" / "data").glob("*/date=2015-04-06"))) == 3


def test_reading_a_day_opens_its_files_alone(spark, tmp_path):
    path = str(tmp_path / "geo")
    day = lambda n: spark.createDataFrame([("a", START + n * 86400, 1.0, 1.0)], GEO_TREND)
    for n in range(3):
        tables.put_geo_table(day(n).unionByName(day(0)), path)
    stored = tables.read_served_geo(spark, path, [date(2015, 4, 7)])
    assert rows(stored, "timebucket") == [(START + 86400,)]
    assert len(stored.inputFiles()) == 1 and "date=2015-04-07" in stored.inputFiles()[0]
    for plan in (stored, lookups.put_geo(stored, day(1))):
        assert "SortAggregate" not in plan._jdf.queryExecution().executedPlan().toString()


def test_newest_points_fold_in_any_order(spark, tmp_path):
    path = str(tmp_path / "newest")
    batch = lambda m, lat: spark.createDataFrame([("a", START, Decimal(m), lat, lat)], tables.NEWEST)
    for name, m, lat in (("1", 5, 1.0), ("2", 9, 2.0), ("2", 99, 9.0), ("3", 7, 3.0)):
        tables.write_newest_batch(batch(m, lat), name, path)
        tables.compact_newest(spark, path)
    assert rows(tables.read_newest(spark, path)) == [("a", START, 2.0, 2.0)]


def test_count_batches_are_idempotent(spark, tmp_path):
    path = str(tmp_path / "counts")
    counts = lambda *r: spark.createDataFrame(list(r), "hashtag string, user_handle string, count bigint")
    tables.write_count_batch(counts(("a", "x", 1), ("a", "y", 2)), 0, path)
    for _ in range(2):
        tables.write_count_batch(counts(("A", "x", 10)), 1, path)
    totals = [("a", "x", 11), ("a", "y", 2)]
    assert rows(tables.read_counts(spark, path)) == totals
    tables.compact_counts(spark, path)
    assert rows(tables.read_counts(spark, path)) == totals
    for _ in range(2):
        tables.write_count_batch(counts(("a", "x", 100)), "late", path)
        assert rows(tables.read_counts(spark, path)) == [("a", "x", 111), ("a", "y", 2)]
    assert not tables.write_count_batch(counts(("a", "x", 10)), 1, path)


def test_hashtag_filter_reaches_the_stored_counts(spark, tmp_path):
    path = str(tmp_path / "counts")
    counts = spark.createDataFrame([("a", "x", 1)], "hashtag string, user_handle string, count bigint")
    tables.write_count_batch(counts, 0, path)
    plan = lookups.lookup_hashtag(tables.read_counts(spark, path), ["A"])._jdf.queryExecution()
    assert "EqualTo(hashtag,a)" in plan.toString()


def scanned(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return re.search(r"ReadSchema: (struct<.*)", plan).group(1)


def test_scans_read_only_what_a_job_needs(spark, tweets, tmp_path):
    tweets(message(1, "#a")).write.parquet(str(tmp_path / "p"))
    posts = read_tweets(spark, str(tmp_path / "p"), "parquet")
    counted = scanned(influence.running_influencers(influence.reshare_uses(posts)))
    assert "text:string" in counted and "retweeted_status" in counted
    assert "entities" not in counted and "place" not in counted and "struct<user" not in counted
    average = scanned(users.user_avg_retweets(users.timeline(users.user_posts(posts))))
    assert "text" not in average and "entities" not in average
