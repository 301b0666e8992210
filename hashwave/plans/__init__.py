"""The four page queries, each for a list of keys or for all of them in one job."""
