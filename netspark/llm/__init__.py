"""Operators of a training-data pipeline: scoring, filtering, searching, packing and storing a corpus."""
