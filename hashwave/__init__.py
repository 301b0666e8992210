"""Hashtag trend, influencer and user analytics as Spark DataFrame jobs."""
