"""Transport-network analytics on Spark DataFrames."""
