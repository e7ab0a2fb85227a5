"""Full-text search and text analytics on Spark DataFrames."""
