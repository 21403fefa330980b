"""Operators on DataFrames: sinks, joins, collapsing by key, rollups, history, layout."""
