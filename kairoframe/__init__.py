"""Temporal event analytics on Spark: signals, events, rallies, metrics, reports and datasets as DataFrames."""
