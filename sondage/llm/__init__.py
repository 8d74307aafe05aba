"""Operators for training-data pipelines: filtering, near duplicates, packing, token stores, fixity."""
