"""Point-in-time risk feature analytics on Spark DataFrames."""
