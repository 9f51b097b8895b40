"""Corpus-scale document audit and training-data preparation as Spark jobs."""
