"""Trace analytics on Spark: operators as DataFrame transforms."""
