"""Column functions: paths, geometry, rasters and edit state."""
