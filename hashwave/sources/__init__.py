"""Reading posts, profiles, old text dumps and the served tables."""
