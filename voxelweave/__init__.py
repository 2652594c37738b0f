"""Spatial, raster and registration analytics on Spark DataFrames."""
