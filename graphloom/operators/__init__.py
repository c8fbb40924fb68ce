"""Operators over benchmark rows: selection, splits, summaries, joins, scores, statistics, refresh."""
