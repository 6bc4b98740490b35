"""Spark-first engine for resolving several recognisers' readings of the same pages into one trusted document."""
