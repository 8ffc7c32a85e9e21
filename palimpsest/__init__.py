"""Document forensics and corpus preparation on Spark DataFrames."""
