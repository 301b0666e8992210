"""What must not grow with one key: rows of points, pages, sketches, what a lookup opens."""

from pyspark.sql import functions as F

from conftest import at, author, message, place, reshare_of, rows
from hashwave.functions.timing import day_of
from hashwave.operators import geo, influence, users
from hashwave.schemas import GEO_TREND
from hashwave.sources import tables
from hashwave.sources.deltas import FirstTable


def test_chunks_are_full_and_follow_one_another(spark, tweets):
    posts = tweets(*(message(n, "#hot #hot" if n % 9 else "#cold", created_at=at(f"20:{n * 7 % 60:02d}:00"), place=place(n, -n)) for n in range(90)))
    uses = geo.geo_uses(posts)
    chunks = geo.point_chunks(uses, "1 day", 8).collect()
    sizes = {}
    for r in sorted(chunks, key=lambda r: (r.hashtag, r.part)):
        assert r.uses == len(r.points) <= 8 and r.part == len(sizes.setdefault(r.hashtag, []))
        sizes[r.hashtag].append(r.uses)
    assert sizes == {"hot": [8] * 20, "cold": [8, 2]}
    together = [tuple(p) for r in sorted((r for r in chunks if r.hashtag == "hot"), key=lambda r: r.part) for p in r.points]
    plain = geo.point_rows(uses, "1 day").where("hashtag = 'hot'").orderBy("ts", "id", "pos").select("ts", "lat", "lng")
    assert together == [tuple(r) for r in plain.collect()]
    assert geo.point_chunks(uses.limit(0), "1 day").count() == 0


def output_rows(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().collectLeaves().head().metrics().get("numOutputRows").get().value()


def test_a_lookup_of_an_absent_hashtag_opens_no_row_group(spark, tmp_path):
    points = spark.range(20_000).select(
        F.concat(F.lit("tag"), "id").alias("hashtag"), F.lit(1_400_000_000).cast("long").alias("timebucket"),
        F.lit(1.0).alias("lat"), F.lit(2.0).alias("lng"),
    )
    tables.write_geo_table(points, str(tmp_path / "plain"))
    put = FirstTable(spark, str(tmp_path / "put"), tables.POINTS, ["hashtag", "timebucket"], ["lat", "lng"], day_of(F.col("timebucket")))
    for part in (points.where("timebucket > 0"), points):
        put.commit(part)
    put.compact()
    plain = tables.read_geo_table(spark, str(tmp_path / "plain"))
    folded = spark.read.schema(GEO_TREND).parquet(*put.read().inputFiles())
    for stored in (plain, folded):
        assert stored.count() == 20_000
        # Both lie within the range of the stored ones.
        assert output_rows(stored.where("hashtag = 'tag10000x'")) == 0
        assert output_rows(stored.where("hashtag = 'tag10000'")) > 0


def test_pages_follow_the_last_post_seen(spark, tweets, tmp_path):
    posts = [message(n, user=author("ann" if n % 3 else "bob")) for n in range(1, 31)]
    table = users.user_posts(tweets(*posts, message(99, user=None)))
    users.write_user_posts(table, str(tmp_path / "posts"))
    table = spark.read.parquet(str(tmp_path / "posts"))
    ids = lambda page: [r.id for r in page.orderBy("user_handle", "place").collect()]
    assert ids(users.next_page(table, {"@ann": None}, 4)) == [29, 28, 26, 25]
    assert ids(users.next_page(table, {"@ann": 25, "@bob": 4, "@none": 9}, 4)) == [23, 22, 20, 19, 3]
    assert ids(users.next_page(table, {}, 4)) == [] and ids(users.next_page(table.limit(0), None, 4)) == []
    last = spark.createDataFrame([("ann", 25), ("ann", 26), ("bob", None)], "user_handle string, last_id bigint")
    assert ids(users.next_page(table, last, 2)) == [23, 22, 30, 27]
    assert ids(users.next_page(table, None, 1)) == [29, 30]
    late = table.unionByName(users.user_posts(tweets(message(31, user=author("ann")))))
    assert ids(users.next_page(late, {"@ann": 25}, 2)) == [23, 22]
    plan = users.next_page(table, {"@ann": 25}, 4)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(user_handle,ann)" in plan and "LessThan(id,25)" in plan


def test_sketches_of_batches_unite(spark, tweets, tmp_path):
    path = str(tmp_path / "people")
    batch = lambda people: influence.resharer_sketches(influence.reshare_uses(tweets(
        *(message(n, "#A", user=author(f"p{n}"), retweeted_status=reshare_of("o")) for n in people)
    )))
    for n, people in enumerate((range(0, 300), range(100, 500), range(0, 300))):
        tables.write_people_batch(batch(people), f"s-{n}", path)
    assert not tables.write_people_batch(batch(range(900, 950)), "s-2", path)
    ((tag, handle, people),) = rows(influence.sketched_resharers(tables.read_people(spark, path)))
    assert (tag, handle) == ("a", "o") and abs(people - 500) <= 500 * influence.SKETCH_ERROR
