"""Operators for training-data pipelines: quality, licences, secrets, URLs, near copies, leaks, models, tokens."""
