"""Spark-first analytics for environmental, subsurface and time-series tables."""
