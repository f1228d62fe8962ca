"""Spark-native pipeline for legal corpora: load, clean, structure, chunk, index and query."""
