"""plans of the density-clustering engine."""
