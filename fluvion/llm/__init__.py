"""Operators for training-data pipelines, their queries and their SQL; nothing else in the library uses them."""
