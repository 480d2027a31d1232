"""Spark-first engine for large-scale spatial morphometrics."""
