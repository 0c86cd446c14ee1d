"""Data preparation and exploratory analytics as Spark DataFrame operators."""
