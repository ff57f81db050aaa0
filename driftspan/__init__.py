"""Trace transmission analytics as Spark DataFrame jobs."""
