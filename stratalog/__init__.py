"""Depth-indexed scanner-log analytics as Spark DataFrame functions."""
