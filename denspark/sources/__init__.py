"""sources of the density-clustering engine."""
