"""Evidence, identity and affinity analytics on Spark DataFrames."""
