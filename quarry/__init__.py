"""Search, ranking and corpus processing on Spark DataFrames."""
