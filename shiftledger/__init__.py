"""Staff performance and target planning on Spark DataFrames."""
