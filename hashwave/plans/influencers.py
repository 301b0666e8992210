"""Influencers of a hashtag."""

from __future__ import annotations

from pyspark.sql import DataFrame

from hashwave.operators.influence import top_influencers, with_profiles
from hashwave.operators.lookups import lookup_hashtag


def trend_influencers(
    totals: DataFrame,
    profiles: DataFrame,
    keywords: list[str] | DataFrame | None = None,
    k: int = 3,
) -> DataFrame:
    """The k most reshared authors of the hashtags, with their profile image."""
    if keywords is not None:
        totals = lookup_hashtag(totals, keywords)
    return with_profiles(top_influencers(totals, k), profiles)
