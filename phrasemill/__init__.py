"""Frequent-pattern mining, phrase parsing and text indexing on Spark DataFrames."""
