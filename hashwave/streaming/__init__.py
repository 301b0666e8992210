"""The operators on streams, and where their output goes."""
