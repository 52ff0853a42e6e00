"""Sequence-graph analytics on Spark DataFrames."""
