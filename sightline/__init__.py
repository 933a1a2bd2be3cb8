"""Sightline: perception analytics on Spark DataFrames."""
