"""gridloom: N-D array, image and volume analytics on Spark DataFrames."""
