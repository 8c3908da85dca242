"""Data-quality monitoring of daily loads, expressed as Spark jobs."""
