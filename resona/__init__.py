"""Spark-first scoring, signal features and evaluation for large audio catalogues."""
