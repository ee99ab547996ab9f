"""Geoscience and mine-planning analytics on Spark DataFrames."""
