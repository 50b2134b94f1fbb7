"""Listings analytics on Spark: pure DataFrame operators with explicit inputs."""
