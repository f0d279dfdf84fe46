"""Code-graph analytics on Spark DataFrames."""
