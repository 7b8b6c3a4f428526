"""Event-aligned signal analytics on Spark DataFrames."""
