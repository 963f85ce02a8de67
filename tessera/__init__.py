"""Catalogue-style analytics as Spark DataFrame transforms."""
