"""Terrain line-of-sight and landmark-label analytics as Spark DataFrame operators."""
