"""Lodestone: document and code analytics as Spark DataFrame operators."""
