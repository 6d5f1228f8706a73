"""Corpus retrieval, evaluation and preparation as Spark jobs."""
