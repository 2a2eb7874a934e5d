"""Corpus retrieval and text processing as Spark DataFrame jobs."""
