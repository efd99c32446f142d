"""Count-catalog analytics on Spark DataFrames."""
