"""Sequence analytics on Spark: scans, windows, joins, statistics and training-data operators as DataFrame programs."""
