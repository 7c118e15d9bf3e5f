"""operators of the density-clustering engine."""
