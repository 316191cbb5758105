"""Audit of data changes on Spark: net changes, capture comparison, trace analysis."""
