"""Occurrence-archive analytics on Spark: sources, operators, plans, streams and exports."""
