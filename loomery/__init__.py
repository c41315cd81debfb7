"""Loomery: corpus preparation and analysis as Spark jobs."""
