"""Analytics toolkit on Spark DataFrames."""
