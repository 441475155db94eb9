"""The three jobs: load, dedup, validate."""
