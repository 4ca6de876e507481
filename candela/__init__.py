"""Grouped-candidate analytics as DataFrame and SQL plans on Apache Spark."""
