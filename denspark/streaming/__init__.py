"""streaming of the density-clustering engine."""
