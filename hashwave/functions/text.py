"""Hashtags, handles and profile image addresses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What a hashtag in a text looks like, and the two size markers in profile image
# addresses.
HASHTAG = r"(?<![^ ])#([^ ]+)"
SMALL_IMAGE = "_normal"
LARGE_IMAGE = "_400x400"

_NO_STRINGS = "array<string>"


def text_hashtags(text: Column) -> Column:
    """Hashtags written in the text, in order, case and repeats kept.

    Words are separated by single spaces only; a hashtag is a word that starts with ``#`` and
    has something after that one mark. So ``#a,`` keeps its comma and ``##a`` gives ``#a``.
    """
    return F.regexp_extract_all(text, F.lit(HASHTAG), F.lit(1))


def entity_hashtags(entities: Column) -> Column:
    """Hashtags from the parsed entities; an empty array when there are none."""
    return _texts(entities.getField("hashtags"), "text")


def entity_mentions(entities: Column) -> Column:
    """Mentioned handles from the parsed entities; an empty array when there are none."""
    return _texts(entities.getField("user_mentions"), "screen_name")


def _texts(items: Column, field: str) -> Column:
    # A field of an array of structs is the array of that field.
    return F.coalesce(items.getField(field), F.array().cast(_NO_STRINGS))


def optional_item(present: Column, value: Column) -> Column:
    """An array of one value, or an empty array when it is not present."""
    return F.when(present, F.array(value)).otherwise(F.array().cast(_NO_STRINGS))


def normalise_tag(tag: Column) -> Column:
    return F.lower(tag)


def normalise_handle(handle: Column) -> Column:
    """Lower case, without one leading ``@``."""
    return F.lower(F.regexp_replace(handle, "^@", ""))


def avatar_url(url: Column) -> Column:
    """Address of the large profile image; an address without the small marker stays as it is."""
    parts = F.split(url, SMALL_IMAGE)
    return F.coalesce(
        F.concat(F.get(parts, F.lit(0)), F.lit(LARGE_IMAGE), F.get(parts, F.lit(1))), url
    )
