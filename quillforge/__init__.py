"""Spark-first engine for curating and evaluating speech and text corpora."""
