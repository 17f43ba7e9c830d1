"""Point-in-time analytics over Spark DataFrames."""
