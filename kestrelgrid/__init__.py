"""Spark-native analytics over flight telemetry, point clouds, surface grids and page texts."""
