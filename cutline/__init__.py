"""Ordered-sequence analytics on Spark."""
