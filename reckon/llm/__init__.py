"""Operators of a training-data pipeline: quality, toxicity, language, dedup, search, mixing, token files.

Each module holds one operator and its registered query; nothing else in the
library imports this subpackage.
"""
