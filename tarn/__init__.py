"""Spark-first exploratory analytics library."""
