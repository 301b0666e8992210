import random

import pytest
from pyspark.sql import functions as F

from conftest import rows
from hashwave.functions.place import in_box
from hashwave.functions.text import avatar_url, normalise_handle, text_hashtags
from hashwave.functions.timing import humanize_seconds, time_slice, timebucket
from hashwave.operators.geo import trend_legend, with_slices
from hashwave.operators.users import with_shares
from hashwave.sources.tweets import parse_created_at


def values(spark, items, kind="string"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(items)], f"i int, v {kind}")


def mapped(spark, items, expression, kind="string"):
    df = values(spark, items, kind).select("i", expression(F.col("v")).alias("out"))
    return [r.out for r in df.orderBy("i").collect()]


@pytest.mark.parametrize(
    "text, tags",
    [
        ("#A #a", ["A", "a"]),
        ("", []),
        ("#", []),
        ("a # b", []),
        ("##x", ["#x"]),
        ("see #x, #y.", ["x,", "y."]),
        ("a#b", []),
        ("#a\n#b  #c", ["a\n#b", "c"]),
        ("\t#a", []),
        ("#a#b", ["a#b"]),
        (None, None),
    ],
)
def test_text_hashtags(spark, text, tags):
    assert mapped(spark, [text], text_hashtags) == [tags]


def test_text_hashtags_follow_single_space_words(spark):
    rng = random.Random(7)
    texts = ["".join(rng.choices("# #ab,\n\t", k=rng.randrange(25))) for _ in range(3000)]
    expected = [[w[1:] for w in t.split(" ") if w.startswith("#") and w != "#"] for t in texts]
    assert mapped(spark, texts, text_hashtags) == expected


def test_handles(spark):
    assert mapped(spark, ["@Ann", "@@b", "C@d"], normalise_handle) == ["ann", "@b", "c@d"]


def test_avatar_url(spark):
    urls = ["http://x/a_normal.png", "http://x/a.png", "http://x/_normal", None]
    large = ["http://x/a_400x400.png", "http://x/a.png", "http://x/_400x400", None]
    assert mapped(spark, urls, avatar_url) == large


def test_created_at(spark):
    texts = ["Mon Apr 06 20:00:00 +0000 2015", "Mon Apr 06 20:00:00 +0200 2015", "soon", None]
    seconds = mapped(spark, texts, lambda v: F.unix_seconds(parse_created_at(v)))
    assert seconds == [1428350400, 1428343200, None, None]


def test_timebucket_is_the_end_of_the_interval(spark):
    df = spark.sql("select timestamp '2015-04-06 20:00:00' as t")
    assert df.select(timebucket(F.col("t"), "15 minutes")).first()[0] == 1428350400 + 900


@pytest.mark.parametrize(
    "seconds, label",
    [
        (0, "0 sec"),
        (59.9, "59 sec"),
        (60, "1 minute(s)"),
        (3599.5, "59 minute(s)"),
        (3600, "1 hr(s)"),
        (86399, "23 hr(s)"),
        (86400, "1 day(s)"),
        (200000, "2 day(s)"),
    ],
)
def test_duration_in_its_largest_unit(spark, seconds, label):
    df = spark.createDataFrame([(float(seconds),)], "x double")
    assert df.select(humanize_seconds("x")).first()[0] == label


def test_duration_in_a_given_unit(spark):
    df = spark.createDataFrame([(200000.9,)], "x double")
    units = ["sec", "minute", "hr", "day"]
    found = list(df.select(*[humanize_seconds("x", u) for u in units]).first())
    assert found == ["200000 sec(s)", "3333 minute(s)", "55 hr(s)", "2 day(s)"]


def test_slices_are_half_open(spark):
    buckets = [100, 119, 120, 139, 140, 160, 180, 199, 200]
    df = spark.createDataFrame([(b, 100, 200) for b in buckets], "t bigint, lo bigint, hi bigint")
    found = [r[0] for r in df.select(time_slice("t", "lo", "hi")).collect()]
    assert found == [1, 1, 2, 2, 3, 4, 5, 5, None]


def test_single_bucket_has_no_slice_and_zero_labels(spark):
    geo = spark.createDataFrame([("a", 100, 1.0, 2.0)], "hashtag string, timebucket bigint, lat double, lng double")
    ranges = spark.createDataFrame([("a", 100, 100)], "hashtag string, oldest bigint, newest bigint")
    assert rows(with_slices(geo, ranges), "slice", "colour", "icon") == [(None, None, None)]
    names = [r.name for r in trend_legend(ranges).orderBy("slice").collect()]
    assert names == ["0 sec - 0 sec"] * 5 + ["More Recent"]


@pytest.mark.parametrize(
    "span, names",
    [
        (
            14400,
            ["0 sec - 48 minute(s)", "48 minute(s) - 1 hr(s)", "1 hr(s) - 2 hr(s)",
             "2 hr(s) - 3 hr(s)", "3 hr(s) - 4 hr(s)"],
        ),
        (
            259200,
            ["0 sec - 14 hr(s)", "14 hr(s) - 1 day(s)", "1 day(s) - 43 hr(s)",
             "1 day(s) - 2 day(s)", "2 day(s) - 3 day(s)"],
        ),
        (
            7000,
            ["0 sec - 23 minute(s)", "23 minute(s) - 46 minute(s)", "46 minute(s) - 1 hr(s)",
             "1 hr(s) - 93 minute(s)", "93 minute(s) - 116 minute(s)"],
        ),
        (
            3,
            ["0 sec - 0 sec", "0 sec - 1 sec", "0 sec - 1 sec", "1 sec - 2 sec", "2 sec - 3 sec"],
        ),
        (
            70,
            ["0 sec - 14 sec", "14 sec - 28 sec", "28 sec - 42 sec", "42 sec - 56 sec",
             "56 sec - 1 minute(s)"],
        ),
        (
            90,
            ["0 sec - 18 sec", "18 sec - 36 sec", "36 sec - 54 sec", "54 sec - 1 minute(s)",
             "1 minute(s) - 90 sec(s)"],
        ),
    ],
)
def test_legend_names(spark, span, names):
    ranges = spark.createDataFrame([("a", 1000, 1000 + span)], "hashtag string, oldest bigint, newest bigint")
    found = trend_legend(ranges).orderBy("slice").collect()
    assert [r.name for r in found][:5] == names
    assert (found[5].name, found[5].colour, found[5].icon) == ("More Recent", "#000000", "000000.gif")


def test_box_holds_its_edges(spark):
    df = spark.createDataFrame([(0.0, 0.0), (10.0, 5.0), (10.1, 5.0), (None, 1.0)], "lat double, lng double")
    inside = df.where(in_box(F.col("lat"), F.col("lng"), 0, 0, 5, 10))
    assert rows(inside) == [(0.0, 0.0), (10.0, 5.0)]


def test_shares(spark):
    df = spark.createDataFrame([("u", "a", 1), ("u", "b", 2), ("v", "a", 0)], "user_handle string, item string, count bigint")
    assert rows(with_shares(df), "user_handle", "item", "share_label") == [
        ("u", "a", "33.3"), ("u", "b", "66.7"), ("v", "a", "0.0")
    ]
