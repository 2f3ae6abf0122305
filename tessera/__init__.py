"""Tessera: text analytics and information retrieval on PySpark DataFrames."""
