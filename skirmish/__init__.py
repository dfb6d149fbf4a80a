"""Spark-first analytics for head-to-head competition data."""
