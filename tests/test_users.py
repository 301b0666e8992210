import json

from conftest import author, entities, message, place, rows
from hashwave.operators import users
from hashwave.plans.users import user_page


def timeline_of(posts, **options):
    return users.timeline(users.user_posts(posts), **options)


def test_newest_pages_of_a_timeline(tweets):
    posts = tweets(*[message(i) for i in range(61)])
    tl = timeline_of(posts, page_size=20, pages=3)
    found = tl.select("id", "rn", "page").orderBy("rn").collect()
    assert [r.id for r in found] == list(range(60, 0, -1))
    assert [r.page for r in found] == [1] * 20 + [2] * 20 + [3] * 20


def test_large_adjacent_ids_stay_apart(tweets):
    ids = [2**53 + i for i in range(5)]
    tl = timeline_of(tweets(*[message(i) for i in ids]), page_size=2, pages=2)
    assert [r.id for r in tl.orderBy("rn").collect()] == ids[:0:-1]


def test_authors_do_not_mix(tweets):
    posts = tweets(
        message(1, user=author("Ann"), retweet_count=4),
        message(2, user=author("ann"), retweet_count=1),
        message(3, user=author("bob"), retweet_count=9),
    )
    assert rows(users.user_avg_retweets(timeline_of(posts))) == [("ann", 2.5), ("bob", 9.0)]


def test_items_are_counted_with_first_appearance(tweets):
    posts = tweets(
        message(1, entities=entities(["x", "y", "x"], ["m"])),
        message(2, entities=entities(["Y", "y"], ["n", "m"])),
        message(3, in_reply_to_screen_name=" bob ", place=place(0, 0, "Rome")),
        message(4, in_reply_to_screen_name="bob", place=place(0, 0, "Oslo")),
        message(5, place=place(0, 0, "Oslo")),
    )
    tl = timeline_of(posts)
    first = lambda df, name: [(r[name], r["count"]) for r in df.orderBy("first_seen").collect()]
    assert first(users.user_hashtags(tl), "hashtag") == [("Y", 1), ("y", 2), ("x", 2)]
    assert first(users.user_mentions(tl), "person") == [("n", 1), ("m", 2)]
    assert first(users.user_replies(tl), "screen_name") == [("bob", 2)]
    assert first(users.user_locations(tl), "location") == [("Oslo", 2), ("Rome", 1)]


def test_equal_counts_keep_the_first_fifteen(tweets):
    names = [f"t{i}" for i in range(16)]
    tl = timeline_of(tweets(message(1, entities=entities(names))))
    top = users.top_n(users.user_hashtags(tl))
    assert [r.hashtag for r in top.orderBy("rank").collect()] == names[:15]


def test_shares_add_up(tweets):
    tl = timeline_of(tweets(message(1, entities=entities(["a", "a", "b"], ["m", "n", "o"]))))
    shares = users.with_shares(users.top_n(users.item_counts(tl))).collect()
    for metric in ("hashtags", "mentions"):
        assert abs(sum(r.share_pct for r in shares if r.metric == metric) - 100) < 1e-9


def test_page_of_a_user(spark, tweets):
    posts = tweets(
        message(1, user=author("Ann"), retweet_count=3, entities=entities(["a", "b", "b"], ["m"])),
        message(2, user=author("Ann"), retweet_count=None, place=place(0, 0, "Rome")),
    )
    profiles = spark.createDataFrame(
        [("ANN", "http://x/a_normal.png", "hi", 10, 20)],
        "screen_name string, profile_image_url string, description string, "
        "followers_count bigint, friends_count bigint",
    )
    page = {r.user_handle: r for r in user_page(posts, profiles, ["@ann", "Nobody"]).collect()}
    ann, nobody = page["ann"], page["nobody"]
    assert ann.an1 == 1.5
    assert json.loads(ann.an2) == [{"hashtag": "b", "count": 2}, {"hashtag": "a", "count": 1}]
    assert json.loads(ann.an3) == [{"person": "m", "count": 1}]
    assert json.loads(ann.an4) == []
    assert json.loads(ann.an5) == [{"location": "Rome", "count": 1}]
    assert (ann.followers_count, ann.following_count, ann.description) == (10, 20, "hi")
    assert ann.avatar_url == "http://x/a_400x400.png"
    assert nobody.an1 is None
    assert [nobody[f"an{i}"] for i in range(2, 6)] == ["[]"] * 4
    assert nobody.followers_count is None


def test_metrics_shuffle_only_for_the_timeline(tweets):
    plan = users.user_analytics(timeline_of(tweets(message(1))))._jdf.queryExecution().executedPlan()
    assert plan.toString().count("Exchange hashpartitioning") == 2
