"""Sighting analytics as PySpark DataFrame operators."""
