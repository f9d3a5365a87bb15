"""Port-to-port delay analytics on Spark DataFrames."""
