"""Operators of a training-data pipeline: labels, duplicates, leaks, personal data, archives, packing."""
