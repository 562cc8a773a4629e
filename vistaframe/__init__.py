"""Terrain, sky and sensor jobs on Spark."""
