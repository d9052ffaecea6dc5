"""Grouped evaluation, alignment and corpus analytics on Spark DataFrames."""
