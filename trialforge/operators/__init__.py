"""Relational and signal operators on DataFrames."""
