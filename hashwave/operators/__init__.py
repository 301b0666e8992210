"""DataFrame operators: hashtag uses and their points, influencers, user metrics, lookups."""
