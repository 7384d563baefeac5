"""Data workloads and benchmark-run analytics on Spark DataFrames."""
