"""Transcript analytics and training-data preparation on PySpark."""
