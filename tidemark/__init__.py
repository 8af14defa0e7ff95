"""Campaign time-series analytics on Spark DataFrames."""
