"""Star-catalogue analytics and large-corpus preparation on Spark DataFrames."""
