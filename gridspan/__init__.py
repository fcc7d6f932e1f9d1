"""Gridded-field and time-series analytics on Spark DataFrames."""
