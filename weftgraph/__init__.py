"""Attributed graphs as plain tables, analysed with Spark's DataFrame and SQL operators."""
