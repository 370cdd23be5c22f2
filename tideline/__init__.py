"""Comparative cohort analytics as PySpark DataFrame operators."""
