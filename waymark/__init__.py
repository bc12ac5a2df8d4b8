"""Set-at-a-time analytics on Spark DataFrames."""
