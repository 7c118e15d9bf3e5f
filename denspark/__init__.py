"""Density-based hierarchical clustering and corpus analytics on PySpark DataFrames."""

__version__ = "0.1.0"
