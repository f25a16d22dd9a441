"""Storage-usage analytics on Spark DataFrames."""
