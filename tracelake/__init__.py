"""Traceability graphs as Spark DataFrames: facts in, merged, derived, validated and queried."""
