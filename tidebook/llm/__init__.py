"""Operators for large text corpora, each a Spark job over whole tables."""
