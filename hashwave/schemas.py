"""Fixed schemas of the inputs and of the two served tables."""

from pyspark.sql import types as T


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


_HASHTAGS = T.ArrayType(_struct(text=T.StringType()))
_MENTIONS = T.ArrayType(_struct(screen_name=T.StringType()))
_BOX = T.ArrayType(T.ArrayType(T.ArrayType(T.DoubleType())))


def _tweet(created_at: T.DataType) -> T.StructType:
    return _struct(
        id=T.LongType(),
        created_at=created_at,
        text=T.StringType(),
        retweet_count=T.LongType(),
        user=_struct(id=T.LongType(), screen_name=T.StringType()),
        in_reply_to_screen_name=T.StringType(),
        # Points are stored as [lng, lat].
        coordinates=_struct(coordinates=T.ArrayType(T.DoubleType())),
        place=_struct(full_name=T.StringType(), bounding_box=_struct(coordinates=_BOX)),
        entities=_struct(hashtags=_HASHTAGS, user_mentions=_MENTIONS),
        retweeted_status=_struct(id=T.LongType(), user=_struct(screen_name=T.StringType())),
    )


TWEET = _tweet(T.TimestampType())

# As delivered in JSON, where created_at reads "Mon Apr 06 20:00:00 +0000 2015".
RAW_TWEET = _tweet(T.StringType())

PROFILE = _struct(
    screen_name=T.StringType(),
    profile_image_url=T.StringType(),
    description=T.StringType(),
    followers_count=T.LongType(),
    friends_count=T.LongType(),
)

# Key (hashtag, timebucket); timebucket is the end of the interval in epoch seconds.
GEO_TREND = _struct(
    hashtag=T.StringType(), timebucket=T.LongType(), lat=T.DoubleType(), lng=T.DoubleType()
)

# Key (hashtag, user_handle).
INFLUENCER = T.StructType(
    [
        T.StructField("hashtag", T.StringType()),
        T.StructField("user_handle", T.StringType()),
        T.StructField("count", T.LongType()),
    ]
)
