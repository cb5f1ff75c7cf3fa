"""Analytics of profiles, measurements at ordered places along named segments, on Spark DataFrames."""
