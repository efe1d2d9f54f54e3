"""Linked-account analytics on Spark DataFrames."""
