"""Areal aggregation on Spark: crosswalk weights, their application and statistics."""
