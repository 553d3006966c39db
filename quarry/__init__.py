"""Spark jobs for research-evidence analytics and training-data preparation."""
