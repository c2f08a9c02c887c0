"""foliospark: document corpus analytics on Spark DataFrames."""
