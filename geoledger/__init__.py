"""Spatial record linkage, survey estimation and data checks as Spark DataFrame plans."""
