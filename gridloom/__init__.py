"""gridloom: raster, spectral and spatial analysis on Spark tables."""
