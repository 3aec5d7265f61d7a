"""Retrieval, ranking and profile analytics as Spark DataFrame operators."""
