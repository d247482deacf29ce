"""Exam analytics and training-data preparation as PySpark DataFrame transformations."""
