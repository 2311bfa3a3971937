"""Operators of a training-data pipeline: media, text, tokens, near copies, shards."""
