"""Corpus curation and memorization measurement on PySpark."""
