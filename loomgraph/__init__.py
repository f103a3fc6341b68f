"""Graph traversal and corpus analytics on Spark DataFrames."""
