"""Approximate sequence search on Spark: sites, similarity joins, post-processing and estimation."""
