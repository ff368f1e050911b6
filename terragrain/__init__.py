"""Density analytics over geographic points, expressed as Spark DataFrame, SQL and Structured Streaming operations."""
