"""functions of the density-clustering engine."""
