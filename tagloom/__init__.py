"""Text-and-tag analytics on Spark DataFrames."""
