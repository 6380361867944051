"""Audit of inspection reports and of training-data corpora as Spark jobs."""
