"""Tag analytics, calibration, vector search and playlist operators on Spark DataFrames."""
