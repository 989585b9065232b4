"""Spark-first static-risk analytics."""
