"""Evidence and control analytics on Spark DataFrames."""
