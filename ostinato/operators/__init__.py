"""Operators: sequences, joins, statistics, samples and recurrences."""
