from conftest import at, author, message, reshare_of, rows
from hashwave.operators import influence, lookups
from hashwave.operators.ranking import top_per_key, top_per_key_wide
from hashwave.plans.influencers import trend_influencers

from pyspark.sql import functions as F

START = 1428350400


def reshare(id, text, of, by="ann", clock="20:00:01"):
    return message(id, text, retweeted_status=reshare_of(of), user=author(by), created_at=at(clock))


def totals(spark, *items):
    return spark.createDataFrame(list(items), "hashtag string, user_handle string, count bigint")


def test_counts_occurrences_of_reshares_only(tweets):
    posts = tweets(
        reshare(1, "RT #A #a", "bob"),
        reshare(2, "RT #a", "bob", clock="20:15:00"),
        reshare(3, "RT #a #b", "cyd"),
        message(4, "#a"),
        reshare(5, "RT no tag", "bob"),
    )
    uses = influence.reshare_uses(posts)
    assert rows(influence.retweet_counts(uses, "15 minutes")) == [
        (START + 900, "A", "bob", 1),
        (START + 900, "a", "bob", 1),
        (START + 900, "a", "cyd", 1),
        (START + 900, "b", "cyd", 1),
        (START + 1800, "a", "bob", 1),
    ]
    assert rows(influence.running_influencers(uses)) == [
        ("a", "bob", 3), ("a", "cyd", 1), ("b", "cyd", 1)
    ]
    # Batches add up to the running totals.
    batches = influence.retweet_counts(uses, "15 minutes")
    assert rows(influence.sum_counts(batches)) == rows(influence.running_influencers(uses))


def test_people_are_counted_once(tweets):
    posts = tweets(
        reshare(1, "#a #a", "bob", by="x"),
        reshare(2, "#a", "bob", by="x"),
        reshare(3, "#A", "bob", by="y"),
    )
    uses = influence.reshare_uses(posts)
    assert rows(influence.distinct_resharers(uses)) == [("a", "bob", 2)]
    assert rows(influence.running_influencers(uses)) == [("a", "bob", 4)]
    assert rows(influence.approx_distinct_resharers(uses)) == [("a", "bob", 2)]


def test_approximate_people_are_close(spark):
    uses = spark.range(20000).selectExpr("'a' AS hashtag", "'bob' AS user_handle", "'p' || id % 5000 AS reshared_by")
    found = influence.approx_distinct_resharers(uses, 0.02).first().people
    assert abs(found - 5000) < 500


def test_ties_go_to_the_lower_handle(spark):
    table = totals(spark, ("a", "d", 5), ("a", "c", 1), ("a", "b", 1), ("a", "e", 3), ("z", "q", 1))
    assert rows(influence.top_influencers(table), "hashtag", "rank", "user_handle") == [
        ("a", 1, "d"), ("a", 2, "e"), ("a", 3, "b"), ("z", 1, "q")
    ]


def test_profiles_attach_without_losing_authors(spark):
    table = totals(spark, ("a", "Bob", 5), ("a", "nobody", 4))
    profiles = spark.createDataFrame([("bob", "http://x/b_normal.png")], "screen_name string, profile_image_url string")
    found = trend_influencers(table, profiles, ["A"])
    assert rows(found, "user_handle", "count", "avatar_url") == [
        ("Bob", 5, "http://x/b_400x400.png"), ("nobody", 4, None)
    ]


def test_accumulate_adds_and_inserts(spark):
    stored = totals(spark, ("a", "bob", 5), ("b", "cyd", 1))
    batch = totals(spark, ("A", "bob", 2), ("c", "dan", 7))
    assert rows(influence.accumulate_counts(stored, batch)) == [
        ("a", "bob", 7), ("b", "cyd", 1), ("c", "dan", 7)
    ]


def test_pair_lookup(spark):
    table = totals(spark, ("a", "bob", 5), ("a", "cyd", 1))
    pairs = spark.createDataFrame([("A", "bob"), ("a", "bob"), ("a", "zed")], "hashtag string, user_handle string")
    assert rows(lookups.lookup_hashtag_user(table, pairs)) == [("a", "bob", 5)]


def test_top_per_key_of_a_hot_key(spark):
    """Two thirds of the rows share a key; ranking in parts gives the same rows."""
    df = spark.range(0, 30000, 1, 16).selectExpr("CASE WHEN id % 3 = 0 THEN id % 50 ELSE -1 END AS k", "id")
    order = [F.col("id").desc()]
    plain = rows(top_per_key(df, ["k"], order, 40))
    for parts in (1, 2, 5, 64):
        assert rows(top_per_key_wide(df, ["k"], order, 40, parts=parts)) == plain
    newest = [r[1] for r in plain if r[0] == -1]
    assert sorted(newest) == sorted([i for i in range(30000) if i % 3][-40:])


def test_ranking_limits_before_the_shuffle(spark):
    df = spark.range(100).selectExpr("id % 3 AS k", "id")
    plan = top_per_key_wide(df, ["k"], [F.col("id").desc()], 4)._jdf.queryExecution().toString()
    assert plan.count("Partial") >= 2 and "WindowGroupLimit" in plan
