"""Corpus analytics and retrieval on PySpark DataFrames."""
