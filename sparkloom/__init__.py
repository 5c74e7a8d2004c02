"""Declarative data-transformation contracts compiled to Spark DataFrames."""
