"""Divergent-subgroup analytics as Spark DataFrame jobs."""
