"""Annotation data engine on PySpark DataFrames."""
