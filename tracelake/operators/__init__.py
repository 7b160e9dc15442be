"""Relational operators on the graph tables; each takes and returns DataFrames."""
