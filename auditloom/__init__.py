"""Corpus-scale source audit expressed as Spark DataFrame jobs."""
