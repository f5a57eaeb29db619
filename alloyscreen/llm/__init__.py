"""Operators of a training-data pipeline: tokens, quality, duplicates, secrets and packing. Nothing else in the library imports them."""
