"""Event-discovery analytics and corpus preparation on Spark DataFrames."""
