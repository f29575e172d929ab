"""Spark jobs that analyse many Python code bases at once."""
