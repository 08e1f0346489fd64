"""Readers and writers: survey tables, statistics cubes, polygons, rasters, stages."""
