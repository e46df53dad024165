"""Corpus search and preparation as Spark DataFrame pipelines."""
